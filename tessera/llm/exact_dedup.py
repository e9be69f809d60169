"""Exact deduplication against an immutable snapshot.

A snapshot is the set of texts already taken in.  Its digests are dealt into
buckets and each bucket gets one static binary-fuse filter.  A new batch is
grouped by digest on its own first; its distinct digests are screened by the
filter of their bucket; only positives go to the exact buckets, where digests and
then bytes are compared.  A bucket's filter meets the batch in pieces of bounded size,
however large the batch is against the snapshot.

``exact_dedup`` does this within one table.  ``write_snapshot`` keeps a snapshot (filters,
digests, texts) in a folder that is never changed afterwards, and ``dedup_against`` holds
any number of later batches against it.

Defined cases: a null text counts as empty; empty texts are copies of each other;
a null id ranks below every id; rows that repeat one id and text are one document,
so they stay or go together; an empty table gives an empty result; further columns
are not looked at.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import renamed, table
from tessera.llm.textkernel import fmix
from tessera.plans.scratch import discard, materialize

#: Digests a bucket should hold, so that its filter is built and used in one task's memory.
BUCKET = 250_000


# --- binary-fuse filter -------------------------------------------------------


def _geometry(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for ``n`` keys, three slots a key."""
    if n <= 1:
        return 4, 3
    seg = 1 << min(18, max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    slots = int(np.ceil(n * factor))
    return seg, max(3, -(-slots // seg) + 2)


def _slots(keys: np.ndarray, seed: int, seg: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in neighbouring segments, and its 8-bit fingerprint."""
    h = fmix(keys ^ np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(count - 2)) >> np.uint64(32)
    base = (first * np.uint64(seg)).astype(np.int64)
    m = np.uint64(seg - 1)
    g = fmix(h)
    at = np.stack([base + ((g >> np.uint64(20 * i)) & m).astype(np.int64) + i * seg for i in range(3)], axis=1)
    return at, (h & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a static filter over distinct 64-bit keys.

    Keys are peeled in rounds: every slot that one key alone uses settles that key.
    A seed whose graph does not peel is replaced by the next.
    """
    keys = np.unique(keys.astype(np.uint64))
    seg, count = _geometry(len(keys))
    size = seg * count
    for seed in range(1, 200):
        at, mark = _slots(keys, seed * 0x9E3779B97F4A7C15 % (1 << 63), seg, count)
        degree = np.bincount(at.ravel(), minlength=size)
        who = np.zeros(size, dtype=np.int64)  # xor of the keys at a slot: the key itself where there is one
        np.bitwise_xor.at(who, at.ravel(), np.repeat(np.arange(len(keys)), 3))
        order, done = [], 0
        slots = np.flatnonzero(degree == 1)
        while len(slots):
            key, pick = np.unique(who[slots], return_index=True)
            own = slots[pick]
            order.append((key, own))
            done += len(key)
            touched = at[key].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(who, touched, np.repeat(key, 3))
            slots = np.unique(touched)
            slots = slots[degree[slots] == 1]
        if done == len(keys):
            table_ = np.zeros(size, dtype=np.uint8)
            for key, own in reversed(order):
                three = at[key]
                value = mark[key] ^ table_[three[:, 0]] ^ table_[three[:, 1]] ^ table_[three[:, 2]]
                table_[own] = value  # the slot was still zero
            return seed * 0x9E3779B97F4A7C15 % (1 << 63), seg, count, table_.tobytes()
        if seed % 20 == 0:
            count += max(1, count // 8)
            size = seg * count
    raise RuntimeError("no seed peels; the keys are not distinct")


def in_filter(keys: np.ndarray, seed: int, seg: int, count: int, data: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one other key in 256."""
    at, mark = _slots(keys.astype(np.uint64), seed, seg, count)
    t = np.frombuffer(data, dtype=np.uint8)
    return (t[at[:, 0]] ^ t[at[:, 1]] ^ t[at[:, 2]]) == mark


# --- the operator -------------------------------------------------------------


def default_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket: the filter over the 64-bit keys of its ``digest`` values."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, seg, count, data = build_filter(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [seed], "seg": [seg], "count": [count], "data": [data]})

    keys = digests.select(F.xxhash64("digest").alias("key"), bucket_of(buckets).alias("bucket"))
    return keys.groupBy("bucket").applyInPandas(make, "bucket long, seed long, seg long, count long, data binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int, pieces: int) -> DataFrame:
    """``batch`` (digest, n, top) with ``maybe``: false where the snapshot certainly lacks the digest.

    Each bucket of the batch is dealt into ``pieces``, and its filter goes to all of them.
    """

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right):
            f = right.iloc[0]
            left["maybe"] = in_filter(left["key"].to_numpy().view(np.uint64), int(f.seed), int(f.seg), int(f["count"]), f.data)
        else:
            left["maybe"] = False
        return left[["digest", "n", "top", "maybe"]]

    keyed = batch.withColumn("key", F.xxhash64("digest")).withColumn("bucket", bucket_of(buckets)).withColumn("piece", F.pmod(F.hash("digest"), F.lit(pieces)))
    filters = filters.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    kind = dict(batch.dtypes)["top"]
    return keyed.groupBy("bucket", "piece").cogroup(filters.groupBy("bucket", "piece")).applyInPandas(test, f"digest binary, n long, top {kind}, maybe boolean")


def grouped(prints: DataFrame) -> DataFrame:
    """(digest, n, top) of the distinct digests among ``prints`` (id, digest)."""
    return prints.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))


def pieces_of(batch: DataFrame, buckets: int, bucket_rows: int) -> int:
    return batch.count() // (buckets * bucket_rows) + 1


@dataclasses.dataclass(frozen=True)
class Snapshot:
    """``stored`` (bucket, digest, text, n, top): distinct texts; ``filters``: one row a bucket."""

    stored: DataFrame
    filters: DataFrame
    buckets: int


def write_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET) -> Snapshot:
    """Keep the distinct texts of ``docs`` and their filters in ``path``, which must not exist yet."""
    rows = renamed(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    prints = materialize(rows.select("id", default_digest(F.col("text")).alias("digest")), "exact-prints")
    groups = materialize(grouped(prints), "exact-snapshot")
    buckets = groups.count() // bucket_rows + 1
    # one text a digest: the least of the rows with the largest id
    held = rows.withColumn("digest", default_digest(F.col("text"))).join(groups, "digest").where("id <=> top").groupBy("digest").agg(F.min("text").alias("text"), F.first("n").alias("n"), F.first("top").alias("top"))
    held.withColumn("bucket", bucket_of(buckets)).repartition("bucket").sortWithinPartitions("bucket", "digest").write.parquet(f"{path}/stored")
    snapshot_filters(groups, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")
    discard(prints, groups)
    return open_snapshot(docs.sparkSession, path)


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    filters = spark.read.parquet(f"{path}/filters")
    first = filters.select("buckets").first()
    return Snapshot(spark.read.parquet(f"{path}/stored"), filters.drop("buckets"), first[0] if first else 1)


def dedup_against(docs: DataFrame, snapshot: Snapshot, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET) -> DataFrame:
    """(id, known_id, keep_id, kept) for every row of a new batch: ``known_id`` is the snapshot's row of equal text, if any.

    Of new texts the row with the largest id stays; of known ones none does.
    """
    rows = renamed(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", default_digest(F.col("text")))
    batch = materialize(grouped(rows.select("id", "digest")), "exact-batch")
    screened = materialize(screen(batch, snapshot.filters, snapshot.buckets, pieces_of(batch, snapshot.buckets, bucket_rows)), "exact-screened")
    hit = screened.where("maybe").select("digest").join(snapshot.stored.select("digest", F.col("text").alias("stored_text"), F.col("top").alias("known")), "digest")
    hit = materialize(hit, "exact-hits")
    found = rows.join(hit, "digest").where("text = stored_text").select("digest", "known").distinct()  # bytes; a digest of 256 bits has one text
    out = rows.select("id", "digest").join(batch.select("digest", "top"), "digest").join(materialize(found, "exact-known").withColumn("is_known", F.lit(True)), "digest", "left")
    keep = F.when(F.col("is_known"), F.col("known")).otherwise(F.col("top"))
    return out.select(F.col("id").alias(id_col), F.col("known").alias("known_id"), keep.alias("keep_id"), (F.col("is_known").isNull() & F.col("id").eqNullSafe(F.col("top"))).alias("kept"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    in_snapshot: Column | None = None,
    digest: Callable[[Column], Column] = default_digest,
    bucket_rows: int = BUCKET,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    ``in_snapshot`` tells the rows of the snapshot from those of the new batch; by
    default a hash of the id halves the table.  ``digest`` may be weak: texts that
    share a digest but not their bytes are regrouped by whole text.
    """
    rows = renamed(docs, id=id_col, text=text_col) if in_snapshot is None else docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), in_snapshot.alias("old"))
    if in_snapshot is None:
        rows = rows.withColumn("old", F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    prints = materialize(rows.select("id", "old", digest(F.col("text")).alias("digest"), F.unhex(F.sha2("text", 256)).alias("sha")), "exact-prints")

    snapshot = materialize(grouped(prints.where("old")), "exact-snapshot")
    batch = materialize(grouped(prints.where("not old")), "exact-batch")
    buckets = max(16, snapshot.count() // bucket_rows + 1)
    screened = materialize(screen(batch, snapshot_filters(snapshot, buckets), buckets, pieces_of(batch, buckets, bucket_rows)), "exact-screened")
    discard(batch)
    positive = screened.where("maybe").select("digest", F.col("n").alias("n2"), F.col("top").alias("top2"))
    stored = snapshot.join(positive, "digest", "left")
    known = stored.select("digest", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("top", "top2").alias("top"))
    false_hits = positive.join(snapshot, "digest", "left_anti").select("digest", F.col("n2").alias("n"), F.col("top2").alias("top"))
    fresh = screened.where("not maybe").select("digest", "n", "top")
    groups = materialize(known.unionByName(fresh).unionByName(false_hits), "exact-groups")

    discard(snapshot, screened)
    # bytes of every row that shares a digest are compared with those of the row that stays
    shared = groups.where("n > 1").select("digest", "top")
    members = rows.select("id", "text", digest(F.col("text")).alias("digest")).join(shared, "digest")
    members = materialize(members, "exact-members")
    stays = members.where("id <=> top").groupBy("digest").agg(F.min("text").alias("stay_text"))
    stays = materialize(stays, "exact-stays")
    other = materialize(members.join(stays, "digest").where("text <> stay_text").select("id", "digest", "text"), "exact-other")
    discard(members, stays)
    placed = prints.select("id", "digest", "sha")
    if other.isEmpty():
        out = placed.join(groups, "digest")
        keep, size = F.col("top"), F.col("n")
    else:
        # a shared digest with other bytes: such texts are told apart by themselves
        again = other.groupBy("digest", "text").agg(F.max("id").alias("own"), F.count(F.lit(1)).alias("own_n"), F.unhex(F.sha2(F.first("text"), 256)).alias("sha"))
        less = other.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
        again = materialize(again.drop("text"), "exact-again")
        out = placed.join(groups, "digest").join(less, "digest", "left").join(again, ["digest", "sha"], "left")
        is_own = F.col("own_n").isNotNull()
        keep = F.when(is_own, F.col("own")).otherwise(F.col("top"))
        size = F.when(is_own, F.col("own_n")).otherwise(F.col("n") - F.coalesce("less", F.lit(0)))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        size.alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
