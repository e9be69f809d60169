"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids and its end id are cut at every ``CAPACITY`` ids; what is left over
is an item.  Items are rounded up to ``STEP`` ids, which leaves a histogram of at
most ``CAPACITY / STEP`` sizes whatever the number of documents.  The driver solves
the linear program over patterns (multisets of sizes that fit a sequence): a simplex
basis gives dual prices, a knapsack dynamic program prices the next column, until no
pattern is worth more than one sequence.  Multiplicities are rounded down, the rest is
packed first-fit decreasing.  Every item is ranked within its size by counts of tasks,
and the rank alone tells its sequence.

Ids equal those of the tokenizers library for the same vocabulary file (tested); the
merges run in tiktoken, which is several times faster.

Defined cases: null and empty texts are the end id alone; a text of any length is
tokenised whole, in segments between which no token can reach; repeated rows are
packed as often as they occur; a null id is carried; an empty table gives no piece.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import renamed, table
from tessera.plans.scratch import materialize

CAPACITY = 1024
END = 0
#: Item sizes are rounded up to this many ids for the linear program.
STEP = 8
SEGMENT = 1 << 20


# --- tokens -------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def encoder(path: str | None):
    """tiktoken over the merges of a byte-level BPE file of the tokenizers library."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves,
    other = [b for b in range(256) if b not in set(printable)]  # the others for code points from 256 on
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), set(special)


_CUT = re.compile(r"(?<=\S) ")


def token_ids(text: str, path: str | None = None) -> np.ndarray:
    """The text's ids; long texts go in segments cut before a space that follows other text, where tokens always part."""
    enc, special = encoder(path)
    if len(text) <= SEGMENT:
        return np.array(enc.encode(text, allowed_special=special, disallowed_special=()), dtype=np.uint32)
    parts, p = [], 0
    while p < len(text):
        m = _CUT.search(text, p + SEGMENT)
        q = m.start() if m else len(text)
        parts.append(np.array(enc.encode(text[p:q], allowed_special=special, disallowed_special=()), dtype=np.uint32))
        p = q
    return np.concatenate(parts)


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """One row a piece, with its size class and its place among the task's pieces of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(CAPACITY // STEP + 1, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = np.append(token_ids(texts[i].as_py() or "", path), np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), CAPACITY):
                    part = ids[start : start + CAPACITY]
                    size = -(-len(part) // STEP) if len(part) < CAPACITY else 0  # class 0: full by itself
                    rows.append((i, start, len(part), zlib.crc32(part.tobytes()), len(ids), size, int(seen[size])))
                    seen[size] += 1
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(x, pa.int64()) for x in c[1:]), pa.array([task] * len(rows), pa.int64())], names=["id", "start", "length", "ids_crc32", "doc_tokens", "size", "nth", "task"])

    kind = dict(docs.dtypes)[id_col]
    return renamed(docs, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, size long, nth long, task long")


# --- column generation --------------------------------------------------------


def best_pattern(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes 1..len(price) within ``capacity`` of the greatest total price: an unbounded knapsack."""
    n = len(price)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        m = min(c, n)
        value = price[:m] + best[c - 1 :: -1][:m]
        k = int(np.argmax(value))
        best[c], took[c] = (value[k], k + 1) if value[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    out, c = np.zeros(n, dtype=np.int64), capacity
    while c > 0:
        if took[c]:
            out[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), out


def column_generation(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Basic patterns (rows), their fractional multiplicities and a lower bound of their sum; ``demand[s-1]`` items of size ``s``.

    Runs until no pattern is worth more than one sequence.  The inverse of the basis is corrected now and then, so errors
    do not add up; a degenerate program whose value stands still for many rounds ends with its bound.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    basis = np.zeros((m, m))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand[sizes - 1]
    product = functools.partial(np.einsum, "ij,jk->ik")  # no threads of a linear algebra library beside the driver's
    value_at, since, n, bound = np.inf, 0, 0, 0.0
    while True:
        n += 1
        if n % 64 == 0:
            inverse = inverse + product(inverse, np.eye(m) - product(basis, inverse))  # one step of Newton's method
            x = np.maximum(inverse @ demand[sizes - 1], 0)
        since = 0 if x.sum() < value_at - 1e-9 * (1 + x.sum()) else since + 1
        value_at = min(value_at, x.sum())
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        price = np.zeros(capacity)
        price[sizes - 1] = np.maximum(duals, 0)
        value, pattern = best_pattern(price, capacity)
        column = pattern[sizes - 1].astype(float)
        bound = max(bound, float(price[sizes - 1] @ demand[sizes - 1]) / max(1.0, value))  # the prices, scaled until no pattern is worth more than 1
        if value <= 1 + 1e-7 or since > 20 * m + 200:
            break
        step = inverse @ column
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        r = int(np.argmin(ratio))
        theta = ratio[r]
        x = np.maximum(x - theta * step, 0)
        x[r] = theta
        basis[:, r] = column
        inverse[r] /= step[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(step[others], inverse[r])
    out = np.zeros((m, len(demand)), dtype=np.int64)
    out[:, sizes - 1] = np.rint(basis.T).astype(np.int64)
    return out, x, bound


def plan_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that together hold exactly ``demand``: the rounded program, then first-fit decreasing."""
    rest, plan = demand.astype(np.int64).copy(), []
    if not rest.any():
        return plan
    patterns, x, _ = column_generation(rest, capacity)
    for k in np.argsort(-x, kind="stable"):
        p = patterns[k]
        times = int(min(np.floor(x[k] + 1e-9), *(rest[p > 0] // p[p > 0])))
        if times > 0:
            plan.append((p, times))
            rest -= p * times
    while rest.any():
        p, room = np.zeros_like(rest), capacity
        for s in np.flatnonzero(rest)[::-1] + 1:
            n = min(room // s, rest[s - 1])
            p[s - 1], room = n, room - n * s
        times = int(min(rest[p > 0] // p[p > 0]))
        plan.append((p, times))
        rest -= p * times
    return plan


def slots(plan: list[tuple[np.ndarray, int]], first: int) -> np.ndarray:
    """Rows (size, rank from, sequence of that rank, slot): ranks from one row on go to one sequence after the other."""
    given: dict[int, int] = {}
    out = []
    for pattern, times in plan:
        slot = 0
        for s in np.flatnonzero(pattern)[::-1] + 1:
            for _ in range(int(pattern[s - 1])):
                out.append((int(s), given.get(int(s), 0), first, slot))
                given[int(s)] = given.get(int(s), 0) + times
                slot += 1
        first += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


# --- the operator -------------------------------------------------------------


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded) for every piece.

    ``padded`` is the length its sequence is padded to: ``CAPACITY``, or its own where that is a power of two.
    """
    cut = materialize(pieces(docs, id_col, text_col, tokenizer), "pack-pieces")
    counts = cut.groupBy("task", "size").agg((F.max("nth") + 1).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("task")) - F.col("n")).drop("n")
    histogram = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CAPACITY / STEP + 1 rows
    full = histogram.pop(0, 0)
    demand = np.zeros(CAPACITY // STEP, dtype=np.int64)
    for s, n in histogram.items():
        demand[s - 1] = n
    plan = np.vstack([[[0, 0, 0, 0]], slots(plan_patterns(demand, CAPACITY // STEP), full)]).astype(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(plan)  # a few rows a pattern, and no more patterns than sizes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        key = p[:, 0] * (1 << 48) + p[:, 1]
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            at = np.searchsorted(key, size * (1 << 48) + rank, side="right") - 1
            keep = batch.select(["id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(p[at, 2] + rank - p[at, 1]), pa.array(p[at, 3])], names=[*keep.schema.names, "sequence_id", "slot"])

    ranked = cut.join(materialize(before, "pack-before"), ["task", "size"]).withColumn("rank", F.col("nth") + F.col("before")).drop("task", "nth", "before")
    kind = dict(docs.dtypes)[id_col]
    placed = ranked.mapInArrow(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot")  # at most CAPACITY rows each
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        (F.sum("length").over(in_sequence) - F.col("length")).alias("offset"),
        F.when(F.bit_count(total) == 1, total).otherwise(F.lit(CAPACITY)).cast("long").alias("padded"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
