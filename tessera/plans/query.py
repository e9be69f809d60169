"""Cell queries: which tables to read, which rows of them, and how coarser rows come apart.

Nothing is enumerated that a join can say: wanted cells at or below the target resolution meet coarser
tables through their ancestor, and query cells coarser than the target meet the tables through the
row's ancestor.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import EmptyCells, InvalidCell, MissingQueryPlaceholder
from tessera.functions import cells
from tessera.plans.schema import CELL
from tessera.plans.tableset import Table, TableSet

TABLE_PLACEHOLDER, CELLS_PLACEHOLDER = "<[table]>", "<[h3indexes]>"
#: A list of cells up to this length becomes a literal filter that reaches the files.
LITERALS = 2000


@dataclasses.dataclass(frozen=True)
class TableSetQuery:
    """All columns, or SQL text run for each table with both placeholders replaced."""

    template: str | None = None

    @classmethod
    def from_template(cls, template: str) -> TableSetQuery:
        return cls(template)

    def check(self) -> None:
        for p in (TABLE_PLACEHOLDER, CELLS_PLACEHOLDER):
            if self.template is not None and p not in self.template:
                raise MissingQueryPlaceholder(f"the query template lacks {p}")


@dataclasses.dataclass
class QueryOptions:
    query: TableSetQuery
    cells: Iterable[int] | DataFrame
    h3_resolution: int
    do_uncompact: bool = True


@dataclasses.dataclass
class Selection:
    """The asked-for cells: ``fine`` at the target resolution, ``coarse`` by their own, coarser resolution.

    No cell of one part lies in a cell of another, so no row is selected twice.  ``literal`` holds the
    same as plain integers where the caller gave a short list.
    """

    resolution: int
    fine: DataFrame | None
    coarse: dict[int, DataFrame]
    literal: dict[int, list[int]] | None = None


def select_cells(spark: SparkSession, wanted: Iterable[int] | DataFrame, resolution: int) -> Selection:
    """Finer cells become their ancestor at ``resolution``; cells inside other cells are dropped."""
    if isinstance(wanted, DataFrame):
        w = wanted.select(F.col(CELL).cast("long").alias(CELL)).distinct()
        w = w.withColumn("_res", F.least(cells.resolution(CELL), F.lit(resolution)))
        levels = sorted(r["_res"] for r in w.select("_res").distinct().collect())  # at most 16 rows
        if not levels:
            raise EmptyCells("no cells to query")
        parts: dict[int, DataFrame] = {}
        for r in levels:
            part = w.where(F.col("_res") == r).select(cells.to_parent(CELL, r).alias(CELL)).distinct()
            for q, upper in parts.items():
                up = upper.select(F.col(CELL).alias("_up"))
                part = part.join(up, cells.to_parent(CELL, q) == F.col("_up"), "left_anti")
            parts[r] = part
        fine = parts.pop(resolution, None)
        return Selection(resolution, fine, parts)
    ids = {int(c) for c in wanted}
    if not ids:
        raise EmptyCells("no cells to query")
    for c in ids:
        if not cells.py_is_valid(c):
            raise InvalidCell(f"not a cell: {c}")
    ids = {cells.py_to_parent(c, resolution) if cells.py_resolution(c) > resolution else c for c in ids}
    by: dict[int, list[int]] = {}
    for c in sorted(ids):
        r = cells.py_resolution(c)
        if not any(cells.py_to_parent(c, q) in ids for q in range(r)):
            by.setdefault(r, []).append(c)
    frames = {r: spark.createDataFrame([(c,) for c in v], f"{CELL} long") for r, v in by.items()}
    return Selection(resolution, frames.pop(resolution, None), frames, by if len(ids) <= LITERALS else None)


def _rows_within(rows: DataFrame, res: int, s: Selection) -> DataFrame:
    """Rows of cells at ``res`` that lie in, or (coarser than the asked-for cells) around, the selection."""
    parts = [*s.coarse.items(), *([(s.resolution, s.fine)] if s.fine is not None else [])]
    around = [part.select(cells.to_parent(CELL, res).alias("_up")) for q, part in parts if q >= res]
    hits = []
    if around:  # one set, so that no row is taken twice
        up = around[0]
        for x in around[1:]:
            up = up.unionByName(x)
        hits.append(rows.join(up.distinct(), rows[CELL] == F.col("_up"), "left_semi"))
    for q, part in parts:
        if q < res:
            hits.append(rows.join(part.select(F.col(CELL).alias("_up")), cells.to_parent(CELL, q) == F.col("_up"), "left_semi"))
    out = hits[0]
    for x in hits[1:]:
        out = out.unionByName(x)
    return out


def take_table(rows: DataFrame, res: int, s: Selection, do_uncompact: bool = True) -> DataFrame:
    """What one table, holding cells at ``res``, contributes."""
    if res == s.resolution or not do_uncompact:
        return _rows_within(rows, res, s)
    values = [c for c in rows.columns if c != CELL]
    out = None
    if s.fine is not None:
        up = s.fine.select(F.col(CELL).alias("_want"), cells.to_parent(CELL, res).alias("_up"))
        out = rows.join(up, rows[CELL] == F.col("_up")).select(F.col("_want").alias(CELL), *values)
    for q, part in s.coarse.items():
        if res >= q:
            up = part.select(F.col(CELL).alias("_up"))
            hit = rows.join(up, cells.to_parent(CELL, q) == F.col("_up"), "left_semi").select(CELL, *values)
        else:
            up = part.select(F.col(CELL).alias("_want"), cells.to_parent(CELL, res).alias("_up"))
            hit = rows.join(up, rows[CELL] == F.col("_up")).select(F.col("_want").alias(CELL), *values)
        hit = cells.expand(hit, s.resolution)
        out = hit if out is None else out.unionByName(hit)
    return out


def cells_at(s: Selection, res: int) -> DataFrame:
    """The selection moved to ``res``: ancestors of finer cells, descendants of coarser ones (the list of a template)."""
    out = None
    for q, part in [*s.coarse.items(), *([(s.resolution, s.fine)] if s.fine is not None else [])]:
        moved = part.select(cells.to_parent(CELL, res).alias(CELL)) if q >= res else cells.expand(part.select(CELL), res)
        out = moved if out is None else out.unionByName(moved)
    return out.distinct()


def pushed_filters(s: Selection, table: Table, schema_partition: Callable[[int, int], tuple[str, int] | None] | None) -> list:
    """Filters on the cell and on the cell's partition that follow from a literal list: both reach the scan."""
    if s.literal is None:
        return []
    exact, parts, known = set(), set(), True
    for r, ids in s.literal.items():
        for c in ids:
            if r >= table.resolution:
                exact.add(cells.py_to_parent(c, table.resolution))
            else:
                known = False
            if schema_partition:
                parts.add(schema_partition(c, r))
    out = [F.col(CELL).isin(sorted(exact))] if known and exact else []
    if schema_partition and parts and None not in parts:
        name = next(iter(parts))[0]
        out.append(F.col(name).isin(sorted({v for _, v in parts})))
    return out


def build_cell_query(
    spark: SparkSession,
    tableset: TableSet,
    options: QueryOptions,
    read: Callable[[Table], DataFrame],
    full_name: Callable[[Table], str],
    partition_of: Callable[[Table], Callable[[int, int], tuple[str, int] | None] | None] | None = None,
) -> DataFrame:
    """The union of what the base table of the resolution and all compacted tables up to it contribute."""
    options.query.check()
    tables = tableset.tables_to_satisfy_query(options.h3_resolution)
    s = select_cells(spark, options.cells, options.h3_resolution)
    columns = [CELL, *sorted(tableset.columns)]
    out = None
    for t in tables:
        if options.query.template is None:
            rows = read(t)
            for f in pushed_filters(s, t, partition_of(t) if partition_of and s.literal is not None else None):
                rows = rows.where(f)
            rows = rows.select(*columns)
        else:
            view = f"tessera_cells_{id(s):x}_{t.name}"
            cells_at(s, t.resolution).createOrReplaceTempView(view)
            rows = spark.sql(options.query.template.replace(TABLE_PLACEHOLDER, full_name(t)).replace(CELLS_PLACEHOLDER, f"(SELECT {CELL} FROM {view})"))
            rows = rows.select(CELL, *sorted(c for c in rows.columns if not c.startswith(CELL)))
            spark.catalog.dropTempView(view)  # the plan holds what it named
        part = take_table(rows, t.resolution, s, options.do_uncompact)
        out = part if out is None else out.unionByName(part)
    return out
