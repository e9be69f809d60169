"""The cell store: tablesets as Parquet tables of a catalog database.

Insert: compact, route by resolution, cascade to coarser base resolutions, append, merge rows of one
key in the partitions that were touched.  All steps are DataFrame jobs; intermediate frames are durable
tables in the shared folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

import dataclasses
import re
import threading
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import Aborted, DatabaseNotFound, EmptyCells, InvalidCell, MissingColumn, StorageError, TableSetNotFound, UnsupportedResolution
from tessera.functions import cells
from tessera.operators.aggregate import cascade
from tessera.operators.compact import compact, uncompact
from tessera.operators.dedupe import merge_rows
from tessera.plans import query as Q
from tessera.plans.schema import BATCH, CELL, PARTITION, ResolutionMetadata, TableSetSchema
from tessera.plans.scratch import discard, materialize
from tessera.plans.tableset import Table, TableSet, find_tablesets, parse_table_name, usable_columns
from tessera.sources.frame import CellFrame, ensure_wrapped, to_spark


@dataclasses.dataclass
class InsertOptions:
    create_schema: bool = True
    deduplicate_after_insert: bool = True
    max_num_rows_per_chunk: int = 1_000_000
    #: Set from another thread to stop: running jobs are cancelled.
    abort: threading.Event = dataclasses.field(default_factory=threading.Event)


def _guard(f):
    """Engine errors come out as StorageError (an IOError) with the engine's message."""

    def run(*args, **kw):
        try:
            return f(*args, **kw)
        except PySparkException as e:
            raise StorageError(str(e)) from e

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


class CellStore:
    def __init__(self, spark: SparkSession, database: str = "default", create_db: bool = False):
        self.spark, self.database = spark, database
        cells.register(spark)
        if create_db:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        if not self.database_exists(database):
            raise DatabaseNotFound(f"database {database} does not exist")

    # --- plain SQL and frames

    def database_exists(self, name: str) -> bool:
        return self.spark.catalog.databaseExists(name)

    @_guard
    def execute(self, sql: str) -> None:
        self._here()
        self.spark.sql(sql).write.format("noop").mode("overwrite").save()  # commands have run by now; queries run here

    @_guard
    def execute_into_dataframe(self, sql: str) -> DataFrame:
        self._here()
        return self.spark.sql(sql)

    @_guard
    def execute_into_h3dataframe(self, sql: str, h3index_column: str = CELL) -> CellFrame:
        self._here()
        return CellFrame(self.spark.sql(sql), h3index_column).validate()

    @_guard
    def insert_dataframe(self, table: str, frame, max_num_rows_per_chunk: int = 0) -> None:
        """Append by column name."""
        df = to_spark(self.spark, frame)
        target = self.spark.table(self._full(table))
        missing = set(df.columns) - set(target.columns)
        if missing:
            raise MissingColumn(f"table {table} has no column {sorted(missing)[0]}")
        out = df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema))
        writer = out.write.option("maxRecordsPerFile", max_num_rows_per_chunk) if max_num_rows_per_chunk else out.write
        writer.insertInto(self._full(table))

    def insert_h3dataframe(self, table: str, frame, h3index_column: str = CELL) -> None:
        self.insert_dataframe(table, ensure_wrapped(self.spark, frame, h3index_column).validate().df)

    def insert_h3dataframe_chunked(self, table: str, frame, max_num_rows_per_chunk: int = 1_000_000) -> None:
        self.insert_dataframe(table, ensure_wrapped(self.spark, frame).validate().df, max_num_rows_per_chunk)

    def _here(self) -> None:
        self.spark.catalog.setCurrentDatabase(self.database)

    def _full(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    # --- tablesets

    def list_tablesets(self) -> dict[str, TableSet]:
        """All tablesets of the database, with the columns that all of their tables share."""
        names = [t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary and parse_table_name(t.name)]
        described = {n: self.spark.table(self._full(n)).dtypes for n in names}
        named = {n: d for n, d in described.items() if CELL in dict(d)}
        out = find_tablesets(list(named))
        for s in out.values():
            s.columns = usable_columns([named[t.name] for t in s.tables])
        return out

    def get_tableset(self, name: str | TableSet) -> TableSet:
        if isinstance(name, TableSet):
            return name
        found = self.list_tablesets().get(name)
        if found is None:
            raise TableSetNotFound(f"tableset {name} not found")
        return found

    @_guard
    def create_tableset(self, schema: TableSetSchema) -> None:
        schema.validate()
        for sql in schema.create_statements(self.database):
            self.spark.sql(sql)

    @_guard
    def drop_tableset(self, name: str | TableSet) -> None:
        """A tableset that does not exist is no error."""
        try:
            found = self.get_tableset(name)
        except TableSetNotFound:
            return
        for t in found.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._full(t.name)}")

    # --- insert

    def _prepared(self, schema: TableSetSchema, frame) -> DataFrame:
        df = ensure_wrapped(self.spark, frame).df
        missing = [c for c in schema.columns if c not in df.columns]
        if missing:
            raise MissingColumn(f"column {sorted(missing)[0]} is missing")
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.spark_schema()))

    def insert_h3dataframe_into_tableset(self, schema: TableSetSchema, frame, options: InsertOptions | None = None) -> None:
        """Rows of one key in the batch are merged first, so base and coarser tables agree.

        Tables are appended one after the other: a failure or an abort in between leaves the tables before it
        with the batch, and inserting it again merges with them.  A tableset has one writer at a time, because
        merging rewrites the partitions it has read.
        """
        options = options or InsertOptions()
        tag, over = f"tessera-insert-{uuid.uuid4().hex}", threading.Event()
        context = self.spark.sparkContext

        def cancel() -> None:
            while not over.wait(0.2):
                if options.abort.is_set():
                    context.cancelJobsWithTag(tag)

        context.addJobTag(tag)
        threading.Thread(target=cancel, daemon=True).start()
        try:
            self._insert(schema, frame, options)
        except (StorageError, Py4JError) as e:
            if options.abort.is_set():
                raise Aborted("insert was stopped") from e
            raise
        finally:
            over.set()
            context.removeJobTag(tag)

    @_guard
    def _insert(self, schema: TableSetSchema, frame, options: InsertOptions) -> None:
        schema.validate()

        def check() -> None:
            if options.abort.is_set():
                raise Aborted("insert was stopped")

        given = materialize(self._prepared(schema, frame), "insert-rows")
        if given.isEmpty():
            return
        coarsest, finest, bad = given.agg(F.min(cells.resolution(CELL)), F.max(cells.resolution(CELL)), F.min(F.struct(cells.is_valid(CELL).alias("ok"), CELL))).first()
        if not bad.ok:
            raise InvalidCell(f"not a cell: {bad[CELL]}")
        top = schema.max_resolution
        if finest > top:
            raise UnsupportedResolution(f"resolution {finest} is finer than {top}")
        check()
        used = [given]
        if not schema.use_compacted_resolutions:
            given = uncompact(given, top)
        given = materialize(self._merged_batch(schema, given), "insert-merged")
        used.append(given)
        unique = True  # no two rows of one key, unless compaction met cells of mixed resolutions
        if schema.use_compacted_resolutions and not schema.uses_sum:
            unique = coarsest == finest
            given = materialize(compact(given, finest), "insert-compact")
            used.append(given)
        given = given.withColumn("_res", cells.resolution(CELL))
        levels = sorted(r["_res"] for r in given.select("_res").distinct().collect())  # at most 16 rows
        if not levels:
            raise EmptyCells("no cells to insert")
        by_res = {r: given.where(F.col("_res") == r).drop("_res") for r in levels}
        check()
        if options.create_schema:
            self.create_tableset(schema)
        methods = {n: c.aggregation for n, c in schema.columns.items() if c.aggregation}
        types = {n: c.spark_type for n, c in schema.columns.items() if n != CELL}

        def keep(df: DataFrame, r: int) -> DataFrame:
            used.append(materialize(df, f"insert-{r:02}"))
            return used[-1]

        base = cascade(by_res, schema.base_resolutions, methods, types, keep, check)
        rows: dict[ResolutionMetadata, DataFrame] = {ResolutionMetadata(r, False): df for r, df in base.items() if df is not None}
        rows |= {ResolutionMetadata(r, True): df for r, df in by_res.items() if r != top}
        batch = time.time_ns()
        for meta, df in sorted(rows.items()):
            check()
            alone = unique and self._stored_in(schema, meta, df).isEmpty()
            self._append(schema, meta, df, batch, options)
            if options.deduplicate_after_insert and not alone:
                check()
                self._merge_partitions(schema, meta, df)
        discard(*used)

    def _merged_batch(self, schema: TableSetSchema, df: DataFrame) -> DataFrame:
        """Rows of one key become one by the engine's rule, as in a stored table: within a partition, by the order key."""
        parts = [(n, e) for n, e in schema.partition_columns(schema.max_resolution) if n != f"{PARTITION}cell"]  # a cell has one cell partition
        named = df.withColumns(dict(parts)) if parts else df
        return merge_rows(named, schema.engine, [*(n for n, _ in parts), *schema.order_key()]).select(*df.columns)

    def _table(self, schema: TableSetSchema, meta: ResolutionMetadata) -> str:
        return self._full(Table(schema.name, meta.resolution, meta.is_compacted, None, schema.has_base_suffix).name)

    def _append(self, schema: TableSetSchema, meta: ResolutionMetadata, df: DataFrame, batch: int, options: InsertOptions) -> None:
        parts = schema.partition_columns(meta.resolution)
        out = df.select(CELL, *schema.value_columns, F.lit(batch).alias(BATCH), *(e.alias(n) for n, e in parts))
        self._write(schema, meta, out, "append", options.max_num_rows_per_chunk)

    def _write(self, schema: TableSetSchema, meta: ResolutionMetadata, out: DataFrame, mode: str, rows: int = 1_000_000) -> None:
        """Dealt by partition in even pieces (a large partition is split), sorted by the order key for row-group pruning."""
        names = [n for n, _ in schema.partition_columns(meta.resolution)]
        target = self._table(schema, meta)
        out = out.select(*self.spark.table(target).columns).hint("rebalance", *names).sortWithinPartitions(*names, *schema.order_key())
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows).insertInto(target, overwrite=mode == "overwrite")

    # --- merging

    def _stored_in(self, schema: TableSetSchema, meta: ResolutionMetadata, touched: DataFrame) -> DataFrame:
        """Stored rows of the partitions that ``touched`` has rows of."""
        names = [n for n, _ in schema.partition_columns(meta.resolution)]
        stored = self.spark.table(self._table(schema, meta))
        if not stored.inputFiles():
            return stored
        hit = touched.select(*(e.alias(n) for n, e in schema.partition_columns(meta.resolution))).distinct()
        values = hit.select(names[0]).distinct().limit(Q.LITERALS + 1).collect()
        if len(values) <= Q.LITERALS:  # a literal filter prunes partitions before planning the join
            stored = stored.where(F.col(names[0]).isin([v[0] for v in values]))
        same = [F.col(f"s.{n}").eqNullSafe(F.col(f"t.{n}")) for n in names]
        return stored.alias("s").join(hit.alias("t"), same, "left_semi")

    def _merge_partitions(self, schema: TableSetSchema, meta: ResolutionMetadata, touched: DataFrame | None) -> None:
        names = [n for n, _ in schema.partition_columns(meta.resolution)]
        stored = self.spark.table(self._table(schema, meta)) if touched is None else self._stored_in(schema, meta, touched)
        merged = merge_rows(stored, schema.engine, [*names, *schema.order_key()])
        merged = materialize(merged, "merge")  # the table is overwritten while it is read otherwise
        if not merged.isEmpty():
            self._write(schema, meta, merged, "overwrite")
        discard(merged)

    @_guard
    def deduplicate_schema(self, schema: TableSetSchema) -> None:
        """Merge rows of one key in every table of the set."""
        found = self.get_tableset(schema.name)
        for t in found.tables:
            self._merge_partitions(schema, ResolutionMetadata(t.resolution, t.is_compacted), None)

    # --- query

    def _read(self, table: Table) -> DataFrame:
        return self.spark.table(self._full(table.name))

    def _partition_of(self, table: Table):
        """Of a cell and its resolution: the cell partition of ``table`` that it lies in, where there is just one."""
        kind = dict(self._read(table).dtypes).get(f"{PARTITION}cell")
        if kind == "int":
            return lambda cell, res: (f"{PARTITION}cell", cells.py_base_cell(cell))
        first = self.spark.sql(f"SHOW PARTITIONS {self._full(table.name)}").first() if kind == "bigint" else None
        if first is None:
            return None
        level = cells.py_resolution(int(re.search(rf"{PARTITION}cell=(-?\d+)", first[0])[1]))  # all partitions are cells of one resolution
        return lambda cell, res: (f"{PARTITION}cell", cells.py_to_parent(cell, level)) if res >= level else None

    @_guard
    def query_tableset_cells(self, tableset: str | TableSet, query: Q.TableSetQuery, wanted: Iterable[int] | DataFrame, h3_resolution: int, do_uncompact: bool = True) -> DataFrame:
        options = Q.QueryOptions(query, wanted, h3_resolution, do_uncompact)
        return Q.build_cell_query(self.spark, self.get_tableset(tableset), options, self._read, lambda t: self._full(t.name), self._partition_of)

    @_guard
    def tableset_stats(self, tableset: str | TableSet) -> DataFrame:
        """Rows stored at each base resolution, rows compacted above it, and the cells both stand for (7 to the difference each)."""
        found = self.get_tableset(tableset)
        counts = None
        for t in found.tables:
            c = self._read(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t.resolution).alias("r"), F.lit(t.is_compacted).alias("c"), "n")
            counts = c if counts is None else counts.unionByName(c)
        rows = {(x.r, x.c): x.n for x in counts.collect()}  # one row a table
        out = []
        for r in found.base_resolutions:
            above = [(c, n) for (c, compacted), n in rows.items() if compacted and c < r]
            at = rows.get((r, False), 0) + rows.get((r, True), 0)
            out.append((r, at, sum(n for _, n in above), at + sum(n * 7 ** (r - c) for c, n in above)))
        return self.spark.createDataFrame(out, "resolution int, num_cells_stored_at_resolution long, num_cells_stored_compacted long, num_cells long").orderBy("resolution")
