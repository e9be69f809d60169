"""Quality by compression: zstandard dictionaries of good and of bad text.

Every block of a text is compressed once with a dictionary built from good
labelled texts and once with one from bad labelled texts.  The difference of the
two sizes over their sum is the evidence of the text; a logistic curve, fitted on
labelled texts that built no dictionary, turns it into a probability.

Defined cases: a null or empty text has evidence 0 and gets the curve's value
there; texts of any length are scored whole, block by block; a null id is scored
like any other and is not held out; repeated rows get equal scores; with no label of
one class every score is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, renamed, table
from tessera.llm.textkernel import buffers
from tessera.plans.scratch import discard, materialize

#: Labelled texts used for fitting, of each class.  They count whole: executors weigh them, and the driver gathers
#: at most ``FIT_BLOCKS`` of their blocks a class for the dictionaries, chosen by a hash.
FIT_ROWS, FIT_BLOCKS = 1500, 4000
#: Block length; a dictionary only helps near the start of what is compressed.
BLOCK = 2048
DICTIONARY = 64 * 1024
LEVEL = 3


@dataclasses.dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _tools(model: Model) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    out = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out[0], out[1]


def evidence(model: Model, texts: Iterator[memoryview | bytes]) -> np.ndarray:
    """(bad size - good size) / (bad size + good size) of each text, over all of its blocks."""
    good, bad = _tools(model)
    out = []
    for t in texts:
        g = b = 0
        for p in range(0, len(t), BLOCK):
            block = t[p : p + BLOCK]
            g += len(good.compress(block))
            b += len(bad.compress(block))
        out.append((b - g) / (b + g) if b + g else 0.0)
    return np.array(out)


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the logistic curve of ``y`` on ``x``, by Newton's method."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def blocks_of(text: bytes) -> list[bytes]:
    return [text[p : p + BLOCK] for p in range(0, len(text), BLOCK)]


def _dictionary(blocks: list[bytes]) -> bytes:
    size = min(DICTIONARY, max(1024, sum(map(len, blocks)) // 4))
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own text is the dictionary
        return b"".join(blocks)[:size] or b" " * 8


def constant(good: int, bad: int) -> Model:
    """The model of too few labels: every score is the share of good ones."""
    share = min(max(good / (good + bad) if good or bad else 0.5, 0.01), 0.99)
    return Model(b" " * 8, b" " * 8, 0.0, float(np.log(share / (1 - share))))


def fit(good: list[bytes], bad: list[bytes]) -> Model:
    """Even texts build the dictionaries, odd ones the curve; then the roles change and the curve is fitted on both."""
    if len(good) < 2 or len(bad) < 2:
        return constant(len(good), len(bad))
    of = lambda texts: [b for t in texts for b in blocks_of(t)]
    xs, ys = [], []
    for part in (0, 1):
        half = Model(_dictionary(of(good[part::2])), _dictionary(of(bad[part::2])), 0, 0)
        for texts, label in ((good[1 - part :: 2], 1.0), (bad[1 - part :: 2], 0.0)):
            xs.append(evidence(half, iter(texts)))
            ys.append(np.full(len(texts), label))
    slope, offset = curve(np.concatenate(xs), np.concatenate(ys))
    return Model(_dictionary(of(good)), _dictionary(of(bad)), slope, offset)


def train_quality(docs: DataFrame, labels: DataFrame, train, rows: int = FIT_ROWS) -> Model:
    """``fit`` on at most ``rows`` labelled texts a class, chosen by a hash of the id among labels for which ``train`` holds.

    Then the curve moves from the sample's class shares to those of all training labels.
    """
    known = renamed(labels, id="doc_id", label="quality").where(train).where("label in (0, 1)").groupBy("id").agg(F.min("label").cast("int").alias("label"))
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = renamed(docs, id="doc_id", text="text").where("octet_length(text) > 0").join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text")).withColumn("half", F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2)).cast("int"))
    texts = materialize(texts, "quality-texts")
    counts = {(r.label, r.half): r["count"] for r in texts.groupBy("label", "half").count().collect()}  # four rows
    n = [sum(k for (c, _), k in counts.items() if c == label) for label in (0, 1)]
    if len(counts) < 4:
        discard(texts)
        return constant(n[1], n[0])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_, label, text, half = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "label", "text", "half"))
            for i in range(batch.num_rows):
                parts = blocks_of(text[i].as_py().encode())
                for s in range(0, len(parts), 512):
                    some = parts[s : s + 512]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i].as_py()] * len(some), x.type) for x in (id_, label, half)] + [pa.array(range(s, s + len(some)), pa.int64()), pa.array(some, pa.binary())], names=["id", "label", "half", "nth", "block"])

    kind = dict(docs.dtypes)["doc_id"]
    blocks = texts.mapInArrow(cut, f"id {kind}, label int, half int, nth long, block binary")
    gathered = {}
    for label, half in counts:
        own = blocks.where((F.col("label") == label) & (F.col("half") == half)).orderBy(F.xxhash64("id", "nth"), "id", "nth").limit(FIT_BLOCKS // 2)
        gathered[label, half] = [bytes(r.block) for r in own.select("block").collect()]
    halves = [Model(_dictionary(gathered[1, h]), _dictionary(gathered[0, h]), 0, 0) for h in (0, 1)]
    sent = docs.sparkSession.sparkContext.broadcast(halves)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = buffers(batch.column(batch.schema.get_field_index("text")))
            half = batch.column(batch.schema.get_field_index("half")).to_numpy()
            view, x = memoryview(raw), np.zeros(batch.num_rows)
            for h in (0, 1):  # each half by the dictionaries of the other
                own = np.flatnonzero(half == h)
                x[own] = evidence(sent.value[1 - h], (view[at[i] : at[i + 1]] for i in own))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("label")), pa.array(x)], names=["id", "label", "x"])

    got = texts.mapInArrow(weigh, f"id {kind}, label int, x double").toPandas().sort_values("id")
    discard(texts)
    slope, offset = curve(got["x"].to_numpy(), got["label"].to_numpy(float))
    model = Model(_dictionary(gathered[1, 0] + gathered[1, 1]), _dictionary(gathered[0, 0] + gathered[0, 1]), slope, offset)
    shares = dict(known.groupBy("label").count().collect())
    model.offset += float(np.log(shares[1] / shares[0]) - np.log(n[1] / n[0]))
    return model


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            at, raw = buffers(batch.column(1))
            view = memoryview(raw)
            x = evidence(m, (view[at[i] : at[i + 1]] for i in range(batch.num_rows)))
            p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["id", "score"])

    return renamed(docs, id=id_col, text=text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            at, raw = buffers(batch.column(place))
            view = memoryview(raw)
            x = evidence(m, (view[at[i] : at[i + 1]] for i in range(batch.num_rows)))
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30))) >= least))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names of any kind come back below
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def is_training(id_col: str = "id"):
    return crc_mod(id_col, 3) != 1


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"), is_training())
    return score_texts(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(crc_mod("id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
