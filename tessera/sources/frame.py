"""Frames with a cell column, to and from what callers hold."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import InvalidCell, MissingColumn
from tessera.functions import cells


@dataclasses.dataclass
class CellFrame:
    """A DataFrame and the name of its cell column."""

    df: DataFrame
    h3index_column_name: str = cells.CELL_COLUMN

    def __post_init__(self):
        if self.h3index_column_name not in self.df.columns:
            raise MissingColumn(f"cell column {self.h3index_column_name} is missing")

    def validate(self) -> CellFrame:
        bad = self.df.where(~cells.is_valid(self.h3index_column_name)).limit(1).collect()
        if bad:
            raise InvalidCell(f"not a cell: {bad[0][self.h3index_column_name]}")
        return self

    def to_arrow(self):
        return self.df.toArrow()

    def to_pandas(self):
        return self.df.toPandas()

    def to_polars(self):
        import polars  # optional

        return polars.from_arrow(self.df.toArrow())


def to_spark(spark: SparkSession, frame) -> DataFrame:
    """Spark, pandas, Arrow and polars frames, and cell frames, as a DataFrame; unsigned cells become signed ones."""
    import pyarrow as pa

    if isinstance(frame, CellFrame):
        return frame.df
    if isinstance(frame, DataFrame):
        return frame
    if hasattr(frame, "to_arrow"):
        frame = frame.to_arrow()
    if not isinstance(frame, pa.Table):
        frame = pa.Table.from_pandas(frame, preserve_index=False)
    kinds = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64()}
    columns = []
    for name, column in zip(frame.column_names, frame.columns, strict=True):
        if column.type == pa.uint64():
            column = column.cast(pa.int64() if name.startswith(cells.CELL_COLUMN) else pa.decimal128(20, 0))
        columns.append(column.cast(kinds.get(column.type, column.type)))
    return spark.createDataFrame(pa.table(columns, names=frame.column_names))


def ensure_wrapped(spark: SparkSession, frame, column: str = cells.CELL_COLUMN) -> CellFrame:
    if isinstance(frame, CellFrame):
        return frame
    df = to_spark(spark, frame)
    if column in df.columns and dict(df.dtypes)[column] != "bigint":
        df = df.withColumn(column, F.col(column).cast("long"))
    return CellFrame(df, column)
