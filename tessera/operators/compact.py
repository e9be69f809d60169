"""Merging complete groups of equal siblings into their parents, and taking them apart again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cells
from tessera.plans.schema import CELL
from tessera.plans.scratch import materialize


def compact(df: DataFrame, finest: int, coarsest: int = 0) -> DataFrame:
    """Cells of mixed resolutions up to ``finest``: children that are all there and agree on all other
    columns become their parent, level by level.  Equal rows count once.

    One aggregation a level: a group is (parent, values) and is complete when it counts all children of
    the parent.  Incomplete groups give their children back.  Stops early once a level merges nothing
    and no coarser rows are left.
    """
    values = [c for c in df.columns if c != CELL]
    rest = df.distinct()
    rest = materialize(rest.withColumn("_res", cells.resolution(CELL)), "compact-rows")
    present = {r["_res"] for r in rest.select("_res").distinct().collect()}  # at most 16 rows
    done, carry = [], None
    for res in range(finest, coarsest, -1):
        own = rest.where(F.col("_res") == res).select(*df.columns) if res in present else None
        level = own if carry is None else carry if own is None else carry.unionByName(own).distinct()
        if level is None:
            continue
        grouped = level.withColumn("_parent", cells.to_parent(CELL, res - 1)).groupBy("_parent", *values).agg(F.collect_set(CELL).alias("_kids"))
        grouped = materialize(grouped.withColumn("_full", F.size("_kids") == cells.child_count("_parent", res)), "compact-level")
        done.append(grouped.where("not _full").select(F.explode("_kids").alias(CELL), *values))
        carry = grouped.where("_full").select(F.col("_parent").alias(CELL), *values)
        if carry.isEmpty():
            carry = None
    last = rest.where(F.col("_res") <= coarsest).select(*df.columns)
    last = last if carry is None else carry.unionByName(last).distinct()
    out = last
    for d in done:
        out = out.unionByName(d.select(*df.columns))
    return out


def uncompact(df: DataFrame, target: int) -> DataFrame:
    """All rows at ``target``: coarser cells become their descendants; finer ones are left out."""
    return cells.expand(df.where(cells.resolution(CELL) <= target), target)
