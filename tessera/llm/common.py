"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under our own names; clashing extra columns never get in."""
    return df.select(*(df[old].alias(new) for new, old in names.items()))
