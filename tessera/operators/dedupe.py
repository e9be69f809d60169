"""What rows of one key become, by engine; a group is aggregated map-side first, so a hot key is no task of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.schema import BATCH, TableEngine


def merge_rows(df: DataFrame, engine: TableEngine, key: list[str], batch: str = BATCH) -> DataFrame:
    """Identical rows collapse first; then, of each key, replacing keeps the row of the highest batch (ties: the
    greatest row), summing adds its columns, aggregating keeps one row; columns stay in order.  Merging twice
    changes nothing more."""
    columns = df.columns
    visible = [c for c in columns if c != batch]
    others = [c for c in visible if c not in key]
    once = df.groupBy(*visible).agg(F.max(batch).alias(batch)) if batch in columns else df.distinct()
    if not others and batch not in columns:
        return once
    lead = [batch] if batch in columns else []
    sums = [c for c in engine.sum_columns if c in others] if engine.name == "summing" else []
    best = F.max(F.struct(*lead, *others)).alias("_row")
    grouped = once.groupBy(*key).agg(best, *(F.sum(c).cast(df.schema[c].dataType).alias(f"_sum_{c}") for c in sums))
    return grouped.select(*(c if c in key else F.col(f"_sum_{c}").alias(c) if c in sums else F.col(f"_row.{c}").alias(c) for c in columns))
