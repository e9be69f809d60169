"""A corpus from raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a DataFrame; ``run``
writes it as Parquet and rereads it as the next stage's ``docs``.  All but the last return the
columns of ``documents``.

1. quality      documents that the compression classifier rejects go
2. exact        of equal texts, the row with the largest id stays
3. near         of linked near-duplicates, the document with the smallest id stays
4. mix          sources get their temperature weights by whole and part repetition; the budget is the
                least that keeps every document once
5. pack         sequences of at most 1024 tokens

Defined cases are those of the operators; besides, rows without id stay in all stages, rows that
repeat an id are treated alike, an empty table passes through as an empty one, and further columns
of any name come along.

Decisions meet the documents by sort merge joins at every size, as those of a large corpus must.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.minhash import near_dedup
from tessera.llm.mixing import mix
from tessera.llm.packing import pack
from tessera.llm.quality import is_training, keep_good, train_quality
from tessera.plans.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels"), is_training()))


def _beside(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs`` as one column ``row`` beside our own ``keys``, so none of their names can clash."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(e.alias(n) for n, e in keys.items()))


def _meet(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    left, right = left.alias("l"), right.alias("r").hint("merge")
    return left.join(right, reduce(lambda p, q: p & q, (F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names)), how)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha"))
    rows = _beside(docs, id=docs["doc_id"], sha=F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)))
    return _meet(rows, materialize(kept, "pipeline-exact"), ["id", "sha"], "left_semi").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_dedup(docs).where("kept").select(F.col("doc_id").alias("id"))
    return _meet(_beside(docs, id=docs["doc_id"]), materialize(kept, "pipeline-near"), ["id"], "left_semi").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = mix(docs, whole=True).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("n"))
    mixed = _meet(_beside(docs, id=docs["doc_id"]), materialize(copies, "pipeline-mix"), ["id"], "inner")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mixing), ("pack", packing)]

#: Training, bisection and column generation have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
