"""Declarative description of a tableset: columns, aggregation, engine, partitions, tables.

One tableset is stored as one table for each base resolution and, for cells merged into their
parents, one for each coarser resolution.
"""

from __future__ import annotations

import dataclasses
import json
import random
import re
import time
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import NoResolutionsDefined, SchemaValidationError, UnsupportedResolution
from tessera.functions import cells

CELL = cells.CELL_COLUMN
#: Hidden columns start with the cell column's name, so that discovery skips them.
BATCH = f"{CELL}_batch_seq"
PARTITION = f"{CELL}_p_"

#: Storable types; unsigned ones are widened so that every value fits.
TYPES: dict[str, T.DataType] = {
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.DecimalType(20, 0),
    "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "Float32": T.FloatType(), "Float64": T.DoubleType(),
    "Date": T.DateType(), "DateTime": T.TimestampType(), "DateTime64": T.TimestampType(), "String": T.StringType(),
}
_ALIASES = {k.lower(): k for k in TYPES} | {"u8": "UInt8", "u16": "UInt16", "u32": "UInt32", "u64": "UInt64", "i8": "Int8", "i16": "Int16", "i32": "Int32", "i64": "Int64", "f32": "Float32", "f64": "Float64"}

AGGREGATIONS = ("relativetocellarea", "sum", "max", "min", "average", "setnullonconflict")
_AGGREGATION_ALIASES = {"avg": "average", "relativetoarea": "relativetocellarea"}

#: Codecs with the default and the allowed range of their parameter.
CODECS: dict[str, tuple[int | None, tuple[int, ...]]] = {
    "lz4hc": (9, tuple(range(1, 10))),
    "zstd": (6, tuple(range(1, 23))),
    "delta": (1, (1, 2, 4, 8)),
    "doubledelta": (None, ()),
    "gorilla": (None, ()),
    "t64": (None, ()),
}


def is_temporal(kind: str) -> bool:
    return kind in ("Date", "DateTime", "DateTime64")


def is_number(kind: str) -> bool:
    return kind.startswith(("UInt", "Int", "Float"))


def type_named(name: str) -> str:
    if name.lower() not in _ALIASES:
        raise ValueError(f"unknown datatype: {name}")
    return _ALIASES[name.lower()]


def aggregation_named(name: str) -> str:
    n = name.lower()
    n = _AGGREGATION_ALIASES.get(n, n)
    if n not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation method: {name}")
    return n


class ResolutionMetadata(NamedTuple):
    """Orders by resolution, base before compacted."""

    resolution: int
    is_compacted: bool


def temporary_key() -> str:
    """Suffix of a staging table: seconds, milliseconds and a random number."""
    now = time.time()
    return f"{int(now)}_{int(now * 1000) % 1000}_{random.getrandbits(16)}"


@dataclasses.dataclass(frozen=True)
class CompressionMethod:
    """A codec, case-insensitive, with its parameter."""

    name: str = "zstd"
    param: int | None = None

    def __post_init__(self):
        n = self.name.lower()
        if n not in CODECS:
            raise ValueError(f"unknown compression method: {self.name}")
        object.__setattr__(self, "name", n)
        if self.param is None:
            object.__setattr__(self, "param", CODECS[n][0])

    def validate(self) -> None:
        _, allowed = CODECS[self.name]
        if allowed and self.param not in allowed:
            raise SchemaValidationError(f"compression parameter {self.param} of {self.name} is not one of {allowed[0]}..{allowed[-1]}")

    def parquet_options(self) -> dict[str, str]:
        """The file codec that comes closest; delta and related encodings are chosen by the Parquet writer itself."""
        if self.name == "lz4hc":
            return {"compression": "lz4"}
        return {"compression": "zstd", "parquet.compression.codec.zstd.level": str(self.param if self.name == "zstd" else 6)}


@dataclasses.dataclass(frozen=True)
class TableEngine:
    """What rows of one key become: replacing keeps the last, summing adds columns, aggregating keeps any."""

    name: str = "replacing"
    sum_columns: tuple[str, ...] = ()

    def __post_init__(self):
        n = self.name.lower().removesuffix("mergetree")
        if n not in ("replacing", "summing", "aggregating"):
            raise ValueError(f"unknown table engine: {self.name}")
        object.__setattr__(self, "name", n)


@dataclasses.dataclass(frozen=True)
class ColumnDefinition:
    """kind: ``simple`` (a grouping key), ``h3index`` or ``aggregated``."""

    kind: str
    datatype: str
    aggregation: str | None = None
    order_key_position: int | None = None
    compression: CompressionMethod | None = None
    nullable: bool = False

    def validate(self, name: str) -> None:
        if self.compression:
            self.compression.validate()
        a, t = self.aggregation, self.datatype
        if a in ("relativetocellarea", "sum", "max", "min", "average") and not is_number(t):
            raise SchemaValidationError(f"column {name}: {a} needs a number, not {t}")
        if a == "setnullonconflict" and not self.nullable:
            raise SchemaValidationError(f"column {name}: {a} needs a nullable column")

    @property
    def spark_type(self) -> T.DataType:
        return T.LongType() if self.kind == "h3index" else TYPES[self.datatype]


@dataclasses.dataclass(frozen=True)
class TemporalPartitioning:
    unit: str = "years"
    count: int = 1

    @classmethod
    def parse(cls, text: str) -> TemporalPartitioning:
        m = re.fullmatch(r"(?:([0-9]+)\s*)?([a-zA-Z]+)", text.strip())
        unit = m and {"month": "months", "months": "months", "year": "years", "years": "years"}.get(m[2].lower())
        if not unit:
            raise ValueError(f"unknown temporal partitioning: {text}")
        out = cls(unit, int(m[1] or 1))
        if out.count < 1:
            raise ValueError("temporal partitioning needs a count above 0")
        return out

    def expression(self, column: Column) -> Column:
        """Years: first year of the span.  Months: number of the span of ``count`` months, or year and hundredths for one."""
        if self.unit == "years":
            return (F.floor(F.year(column) / self.count) * self.count).cast("int")
        if self.count == 1:
            return F.ceil(F.year(column) * 100 + F.lit(100) * (F.month(column) - 1) / 12).cast("int")
        return F.floor((F.year(column) * 12 + F.month(column) - 1) / self.count).cast("int")


@dataclasses.dataclass(frozen=True)
class CellPartitioning:
    """By base cell, or by the ancestor ``difference`` resolutions up."""

    kind: str = "basecell"
    difference: int = 8

    def __post_init__(self):
        k = self.kind.lower().replace("_", "")
        if k not in ("basecell", "lowerresolution"):
            raise ValueError(f"unknown cell partitioning: {self.kind}")
        object.__setattr__(self, "kind", k)

    def expression(self, cell: Column | str, res: int) -> Column:
        if self.kind == "basecell":
            return cells.base_cell(cell)
        return cells.to_parent(cell, max(0, res - self.difference))

    def of(self, cell: int, res: int) -> int:
        return cells.py_base_cell(cell) if self.kind == "basecell" else cells.py_to_parent(cell, max(0, res - self.difference))

    @property
    def coarsest(self) -> int:
        """Difference of the partition's resolution to a table's; a cell at or below it has one partition."""
        return 99 if self.kind == "basecell" else self.difference


@dataclasses.dataclass(frozen=True)
class TableSetSchema:
    name: str
    columns: dict[str, ColumnDefinition]
    base_resolutions: tuple[int, ...]
    engine: TableEngine = TableEngine()
    compression: CompressionMethod = CompressionMethod()
    use_compacted_resolutions: bool = True
    temporal_resolution: str = "second"
    temporal_partitioning: TemporalPartitioning = TemporalPartitioning()
    cell_partitioning: CellPartitioning = CellPartitioning()
    partition_by: tuple[str, ...] = ()
    has_base_suffix: bool = True

    # --- validation

    def validate(self) -> None:
        validate_table_name(self.name)
        self.compression.validate()
        if CELL not in self.columns or self.columns[CELL].kind != "h3index":
            raise SchemaValidationError(f"a cell column named {CELL} is missing")
        for name, column in self.columns.items():
            column.validate(name)
        for c in self.engine.sum_columns:
            if c not in self.columns:
                raise SchemaValidationError(f"column to sum is missing: {c}")
        for c in self.partition_by:
            if c not in self.columns:
                raise SchemaValidationError(f"partition column is missing: {c}")
        if not self.base_resolutions:
            raise NoResolutionsDefined("no base resolutions are defined")
        for r in self.base_resolutions:
            if not 0 <= r <= cells.MAX_RESOLUTION:
                raise UnsupportedResolution(f"resolution {r} is not supported")
        if self.temporal_partitioning.count < 1:
            raise SchemaValidationError("temporal partitioning needs a count above 0")
        self.partition_columns(self.max_resolution)

    # --- derived

    @property
    def max_resolution(self) -> int:
        return max(self.base_resolutions)

    @property
    def uses_sum(self) -> bool:
        return any(c.aggregation == "sum" for c in self.columns.values())

    @property
    def value_columns(self) -> list[str]:
        return sorted(c for c in self.columns if c != CELL)

    def order_key(self) -> list[str]:
        """The cell first, then columns with a position, ties by name: the key that rows are merged by."""
        with_position = [(-100 if n == CELL else c.order_key_position, n) for n, c in self.columns.items() if n == CELL or c.order_key_position is not None]
        return [n for _, n in sorted(with_position)]

    def partition_columns(self, res: int) -> list[tuple[str, Column]]:
        """(hidden column, expression), the cell's first."""
        out = [(f"{PARTITION}cell", self.cell_partitioning.expression(CELL, res))]
        names = list(dict.fromkeys(self.partition_by))
        if not names:
            names = [n for n, c in sorted(self.columns.items()) if is_temporal(c.datatype) and c.kind != "h3index"]
            if len(names) > 1:
                raise SchemaValidationError("several temporal columns could partition; name the columns with partition_by")
        for n in names:
            if n == CELL:
                continue
            out.append((f"{PARTITION}{n}", self.temporal_partitioning.expression(F.col(n)) if is_temporal(self.columns[n].datatype) else F.col(n)))
        return out

    def tables(self) -> list[ResolutionMetadata]:
        """Every base resolution, then the compacted ones from 0 to the finest."""
        out = [ResolutionMetadata(r, False) for r in sorted(self.base_resolutions)]
        return out + ([ResolutionMetadata(r, True) for r in range(self.max_resolution + 1)] if self.use_compacted_resolutions else [])

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(CELL, T.LongType(), False)] + [T.StructField(n, self.columns[n].spark_type, self.columns[n].nullable) for n in self.value_columns])

    # --- statements

    def create_statement(self, meta: ResolutionMetadata, database: str | None = None, temporary: str | None = None) -> str:
        from tessera.plans.tableset import table_name

        t = table_name(self.name, meta.resolution, meta.is_compacted, temporary, self.has_base_suffix)
        full = f"`{database}`.`{t}`" if database else f"`{t}`"
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark_schema()] + [f"`{BATCH}` bigint"]
        partitions = []
        for n, _ in self.partition_columns(meta.resolution):
            source = self.columns.get(n.removeprefix(PARTITION))
            if n == f"{PARTITION}cell":
                kind = "int" if self.cell_partitioning.kind == "basecell" else "bigint"
            else:
                kind = "int" if is_temporal(source.datatype) else source.spark_type.simpleString()
            partitions.append((n, kind))
        body = ", ".join(fields + [f"`{n}` {k}" for n, k in partitions])
        by = "" if temporary else " PARTITIONED BY (" + ", ".join(f"`{n}`" for n, _ in partitions) + ")"
        options = ", ".join(f"'{k}'='{v}'" for k, v in self.compression.parquet_options().items())
        return f"CREATE TABLE IF NOT EXISTS {full} ({body}) USING parquet OPTIONS ({options}){by}"

    def create_statements(self, database: str | None = None) -> list[str]:
        return [self.create_statement(m, database) for m in self.tables()]

    def drop_statements(self, database: str | None = None) -> list[str]:
        from tessera.plans.tableset import table_name

        prefix = f"`{database}`." if database else ""
        return [f"DROP TABLE IF EXISTS {prefix}`{table_name(self.name, m.resolution, m.is_compacted, None, self.has_base_suffix)}`" for m in self.tables()]

    sql_statements = create_statements

    # --- JSON

    def to_json_string(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json_string(cls, text: str) -> TableSetSchema:
        try:
            d = json.loads(text)
            codec = lambda x: CompressionMethod(**x) if x else None
            d["columns"] = {n: ColumnDefinition(**(c | {"compression": codec(c["compression"])})) for n, c in d["columns"].items()}
            d["engine"] = TableEngine(d["engine"]["name"], tuple(d["engine"]["sum_columns"]))
            d["compression"] = codec(d["compression"])
            d["temporal_partitioning"] = TemporalPartitioning(**d["temporal_partitioning"])
            d["cell_partitioning"] = CellPartitioning(**d["cell_partitioning"])
            d["base_resolutions"], d["partition_by"] = tuple(d["base_resolutions"]), tuple(d["partition_by"])
            return cls(**d)
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise SchemaValidationError(f"not a schema: {e}") from e


def validate_table_name(name: str) -> None:
    if not re.fullmatch(r"[a-zA-Z].[_a-zA-Z0-9]+", name):
        raise SchemaValidationError(f"not a usable table name: {name!r}")


class TableSetSchemaBuilder:
    """Collects settings in any order; ``build`` validates them."""

    def __init__(self, name: str):
        self._d: dict = {"name": name, "columns": {}, "base_resolutions": ()}
        self.add_h3index_column(CELL)

    def table_engine(self, name: str, column_names: list[str] | None = None) -> TableSetSchemaBuilder:
        self._d["engine"] = TableEngine(name, tuple(column_names or ()))
        if self._d["engine"].name == "summing" and not column_names:
            raise ValueError("the summing engine needs column names")
        return self

    def compression_method(self, method: CompressionMethod) -> TableSetSchemaBuilder:
        self._d["compression"] = method
        return self

    def use_compacted_resolutions(self, use: bool) -> TableSetSchemaBuilder:
        self._d["use_compacted_resolutions"] = bool(use)
        return self

    def h3_base_resolutions(self, resolutions: list[int]) -> TableSetSchemaBuilder:
        self._d["base_resolutions"] = tuple(sorted(set(map(int, resolutions))))
        return self

    def _column(self, name: str, kind: str, datatype: str, aggregation: str | None, order_key_position, compression_method, nullable) -> TableSetSchemaBuilder:
        self._d["columns"][name] = ColumnDefinition(kind, datatype, aggregation, order_key_position, compression_method, bool(nullable))
        return self

    def add_column(self, name: str, datatype: str, order_key_position: int | None = None, compression_method: CompressionMethod | None = None, nullable: bool = False) -> TableSetSchemaBuilder:
        return self._column(name, "simple", type_named(datatype), None, order_key_position, compression_method, nullable)

    def add_h3index_column(self, name: str) -> TableSetSchemaBuilder:
        return self._column(name, "h3index", "UInt64", None, None, None, False)

    def add_aggregated_column(self, name: str, datatype: str, method: str, order_key_position: int | None = None, compression_method: CompressionMethod | None = None, nullable: bool = False) -> TableSetSchemaBuilder:
        return self._column(name, "aggregated", type_named(datatype), aggregation_named(method), order_key_position, compression_method, nullable)

    def temporal_resolution(self, name: str) -> TableSetSchemaBuilder:
        if name.lower() not in ("second", "day"):
            raise ValueError(f"unknown temporal resolution: {name}")
        self._d["temporal_resolution"] = name.lower()
        return self

    def temporal_partitioning(self, text: str) -> TableSetSchemaBuilder:
        self._d["temporal_partitioning"] = TemporalPartitioning.parse(text)
        return self

    def h3_partitioning(self, kind: str, resolution_difference: int = 8) -> TableSetSchemaBuilder:
        self._d["cell_partitioning"] = CellPartitioning(kind, resolution_difference)
        return self

    def partition_by(self, columns: list[str]) -> TableSetSchemaBuilder:
        self._d["partition_by"] = tuple(columns)
        return self

    def build(self) -> TableSetSchema:
        out = TableSetSchema(**self._d)
        out.validate()
        return out
