"""Toxicity from positive and unlabelled text.

Only confirmed toxic texts count as labelled; every other training text is
unlabelled.  Linear classifiers over hashed words are trained in numpy on the
non-negative positive-unlabelled risk

    prior * R+(positives)  +  max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss: where the second term turns negative, its gradient is
undone instead of followed.  The class prior is the toxic share of the training
labels, which the rows labelled harmless enter too; nothing else is learnt from
them.  Classifiers of several ridge penalties are trained on folds of the fitting
texts; one of the penalty with the least error on the texts left out is then trained
on all of them.

Defined cases: null and empty texts have no words and score the intercept alone;
texts of any length count whole; repeated rows score alike; a null id is scored and
not held out; without positives every score is the prior.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, renamed, table
from tessera.llm.textkernel import buffers, text_groups, words

#: Confirmed toxic texts, and unlabelled texts, used for fitting: the bound of what the driver gathers.
FIT_POSITIVE, FIT_UNLABELLED = 2000, 6000
#: Hash buckets of words, and the fewest fitting texts a word must be in to get a weight.
BITS, SEEN = 20, 3
#: The ridge penalties tried on folds of the fitting texts.
RIDGES, FOLDS = (0.01, 0.1, 1.0, 10.0), 3
STEPS, RATE = 300, 0.1


@dataclasses.dataclass
class Model:
    weight: np.ndarray  # float32, 2**BITS
    offset: float


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of consecutive texts, and where each text's begin."""
    h, first = words(raw, at)
    bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    key = np.unique((doc << BITS) | bucket)
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(len(at)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that begin at ``first``, whose last entry ends them; an empty run sums to 0."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], dtype=np.float64)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: list[bytes], unlabelled: list[bytes], prior: float) -> Model:
    """The classifier from texts."""
    made = lambda texts: [features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    folds = lambda texts: np.array([zlib.crc32(t) % FOLDS for t in texts])
    return fit_features(made(positive), made(unlabelled), folds(positive), folds(unlabelled), prior)


def fit_features(p: list[np.ndarray], u: list[np.ndarray], fold_p: np.ndarray, fold_u: np.ndarray, prior: float) -> Model:
    """The classifier from the word buckets of positive and unlabelled texts; equal texts must share a fold, as
    positives may be among the unlabelled too."""
    prior = min(max(prior, 1e-3), 0.999)
    if not p or not u:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    w, b = _train(p, u, p, u, prior, _ridge(p, u, fold_p, fold_u, prior))
    return Model(w.astype(np.float32), b)


def _ridge(p: list[np.ndarray], u: list[np.ndarray], fold_p: np.ndarray, fold_u: np.ndarray, prior: float) -> float:
    """The penalty of the least positive-unlabelled error on texts held out of training; the strongest of equals."""
    best = (np.inf, RIDGES[-1])
    for ridge in reversed(RIDGES):
        hit_p, hit_u = [], []
        for k in range(FOLDS):
            p_in, u_in = [p[i] for i in np.flatnonzero(fold_p != k)], [u[i] for i in np.flatnonzero(fold_u != k)]
            if not p_in or not u_in:
                continue
            w, b = _train(p_in, u_in, p_in, u_in, prior, ridge)
            hit_p += [w[p[i]].sum() + b >= 0 for i in np.flatnonzero(fold_p == k)]
            hit_u += [w[u[i]].sum() + b >= 0 for i in np.flatnonzero(fold_u == k)]
        if not hit_p or not hit_u:
            continue
        error = prior * (1 - np.mean(hit_p)) + max(0.0, np.mean(hit_u) - prior * np.mean(hit_p))
        if error < best[0]:
            best = (error, ridge)
    return best[1]


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk for scores of positive and unlabelled texts; losses are log(1+e^-z) and log(1+e^z)."""
    return prior * float(np.mean(np.logaddexp(0, -zp))), float(np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp)))


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step descends along, for each score: the risk's gradient, or where its second term is negative that term's, turned round."""
    sp, su = _sigmoid(zp), _sigmoid(zu)
    if risk(zp, zu, prior)[1] >= 0:
        return (prior * (sp - 1) - prior * sp) / len(sp), su / len(su)
    return prior * sp / len(sp), -su / len(su)


def _train(all_p: list[np.ndarray], all_u: list[np.ndarray], p: list[np.ndarray], u: list[np.ndarray], prior: float, ridge: float) -> tuple[np.ndarray, float]:
    """One classifier: Adagrad steps over the texts p and u, drawn from all_p and all_u.

    Every word of ``SEEN`` texts has a weight; its penalty is ``ridge`` over the fourth power of the standard errors
    between its shares of all_p and all_u, so the words of a long harmless text add next to nothing.
    """
    in_p, in_u = (np.bincount(np.concatenate(part), minlength=1 << BITS) for part in (all_p, all_u))
    n_p, n_u = len(all_p), len(all_u)
    pooled = (in_p + in_u) / (n_p + n_u)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
    keep = np.flatnonzero(in_p + in_u >= SEEN)
    scale = np.maximum(np.abs(in_p / n_p - in_u / n_u)[keep] / spread[keep], 0.01) ** 2
    dim = len(keep)
    index = np.full(1 << BITS, -1)
    index[keep] = np.arange(dim)
    p, u = ([x[x >= 0] for x in (index[f] for f in part)] for part in (p, u))
    cut_p, cut_u = (np.concatenate([[0], np.cumsum([len(x) for x in part])]) for part in (p, u))
    jp, ju = np.concatenate(p), np.concatenate(u)
    at_p, at_u = (np.repeat(np.arange(len(part)), [len(x) for x in part]) for part in (p, u))
    by_word = np.argsort(np.concatenate([jp, ju]), kind="stable")
    text_of = np.concatenate([at_p, at_u + len(p)])[by_word]  # the texts of each word, one word after the other
    word_cut = np.searchsorted(np.concatenate([jp, ju])[by_word], np.arange(dim + 1))
    v, square = np.zeros(dim), np.full(dim, 1e-6)
    b, square_b = float(np.log(prior / (1 - prior))), 1e-6
    for _ in range(STEPS):
        w = v * scale
        zp, zu = _sums(w[jp], cut_p) + b, _sums(w[ju], cut_u) + b
        dp, du = slopes(zp, zu, prior)
        grad = scale * _sums(np.concatenate([dp, du])[text_of], word_cut) + ridge * v
        g = dp.sum() + du.sum()
        square += grad**2
        square_b += g**2
        v -= RATE * grad / np.sqrt(square)
        b -= RATE * g / np.sqrt(square_b)
    out = np.zeros(1 << BITS)
    out[keep] = v * scale
    return out, b


def training_features(docs: DataFrame, labels: DataFrame, train) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, float]:
    """Word buckets and folds of positives and unlabelled texts, and the class prior; bounded by FIT_POSITIVE and FIT_UNLABELLED rows.

    Texts count whole, whatever their length: only their distinct word buckets leave the executors.
    """
    known = renamed(labels, id="doc_id", label="toxic").where(train).where("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    usable = renamed(docs, id="doc_id", text="text").where("octet_length(text) > 0").where(train)
    positives = known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(FIT_POSITIVE)
    others = usable.select("id").orderBy(F.xxhash64("id"), "id").limit(FIT_UNLABELLED)  # whatever their labels say
    chosen = positives.select("id", F.lit(True).alias("p")).unionByName(others.select("id", F.lit(False).alias("p"))).groupBy("id").agg(F.max("p").alias("p"), F.min("p").alias("only"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = buffers(batch.column(batch.schema.get_field_index("text")))
            f, first = [], [0]
            for i, j in text_groups(at):
                own, begin = features(raw, at[i : j + 1])
                f.append(own)
                first += (begin[1:] + first[-1]).tolist()
            words_ = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(f) if f else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "p", "only", "crc"]).columns, words_], names=["id", "p", "only", "crc", "words"])

    picked = usable.join(F.broadcast(chosen), "id").select("id", "p", "only", F.crc32("text").alias("crc"), "text")
    got: pd.DataFrame = picked.mapInArrow(run, f"id {dict(docs.dtypes)['doc_id']}, p boolean, only boolean, crc long, words array<int>").toPandas()
    got = got.sort_values(["id", "crc"]).drop_duplicates("id")
    parts = [got[got["p"].astype(bool)], got[~got["only"].astype(bool)]]
    made = [[np.asarray(x, np.int64) for x in part["words"]] for part in parts]
    folds = [part["crc"].to_numpy(np.int64) % FOLDS for part in parts]
    return made[0], made[1], folds[0], folds[1], (toxic / n if n else 0.5)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            at, raw = buffers(batch.column(1))
            z = np.full(batch.num_rows, m.offset)
            for i, j in text_groups(at):
                f, first = features(raw, at[i : j + 1])
                z[i:j] += _sums(m.weight[f], first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(z))], names=["id", "score"])

    return renamed(docs, id=id_col, text=text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double")


def is_training(id_col: str = "id"):
    return crc_mod(id_col, 5) != 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_features(*training_features(docs, table(spark, sf_dir, "labels"), is_training()))
    return score_texts(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(crc_mod("id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
