"""Aggregation of cells to coarser resolutions, as a cascade of neighbouring base resolutions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import cells
from tessera.plans.schema import CELL, TableSetSchema


def aggregate_expression(method: str, column: str, parent: Column, source_resolution: int) -> Column:
    """One of the six methods over the rows of a parent cell.

    sum, max, min, average: over the rows present, nulls ignored.  relativetocellarea: the sum over the
    number of children the parent has, so missing children count as 0.  setnullonconflict: the one
    distinct value, or null if there are several.
    """
    c = F.col(column)
    if method == "sum":
        return F.sum(c)
    if method == "max":
        return F.max(c)
    if method == "min":
        return F.min(c)
    if method == "average":
        return F.avg(c)
    if method == "relativetocellarea":
        return F.sum(c) / F.first(cells.child_count(parent, source_resolution))
    if method == "setnullonconflict":
        return F.when(F.min(c) == F.max(c), F.min(c))
    raise ValueError(f"unknown aggregation method: {method}")


def aggregate_to(df: DataFrame, source: int, target: int, methods: dict[str, str], types: dict[str, T.DataType] | None = None) -> DataFrame:
    """Rows at ``source`` grouped by their parent at ``target`` and by every column without a method."""
    types = types or {}
    keys = [c for c in df.columns if c != CELL and c not in methods]
    lifted = df.withColumn(CELL, cells.to_parent(CELL, target))
    out = lifted.groupBy(CELL, *keys).agg(*(aggregate_expression(m, c, F.col(CELL), source).alias(c) for c, m in methods.items()))
    return out.select(CELL, *(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns if c != CELL))


def expand_to(df: DataFrame, target: int) -> DataFrame:
    """Every row repeated for each descendant of its cell at ``target``."""
    return cells.expand(df, target)


def cascade(
    by_resolution: dict[int, DataFrame],
    base_resolutions: Iterable[int],
    methods: dict[str, str],
    types: dict[str, T.DataType] | None = None,
    keep: Callable[[DataFrame, int], DataFrame] = lambda df, res: df,
    check: Callable[[], None] = lambda: None,
) -> dict[int, DataFrame]:
    """Frames of all base resolutions, the finest as given.

    ``by_resolution`` holds rows by the resolution of their cells.  A step from s to t takes what the step
    before made for s, and all given rows coarser than that down to t + 1, expanded to s.  ``keep`` is
    applied to each result (to cut its lineage) before the next step reads it.
    """
    levels = sorted(set(base_resolutions), reverse=True)
    out = {levels[0]: by_resolution.get(levels[0])}
    for s, t in zip(levels, levels[1:], strict=False):
        check()
        parts = [out[s]] if out[s] is not None else []
        for r in range(t + 1, s + 1):
            if r in by_resolution and r != levels[0]:
                parts.append(by_resolution[r] if r == s else expand_to(by_resolution[r], s))
        if not parts:
            out[t] = None
            continue
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        out[t] = keep(aggregate_to(whole, s, t, methods, types), t)
    return out
