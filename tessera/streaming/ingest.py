"""Inserting a stream: every micro-batch is one insert, and aggregation holds within it, as for any insert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.schema import TableSetSchema
from tessera.sources.store import CellStore, InsertOptions


def insert_stream(store: CellStore, schema: TableSetSchema, stream: DataFrame, checkpoint: str, options: InsertOptions | None = None, **trigger) -> StreamingQuery:
    """Start the stream.  A batch that is repeated after a failure appends its rows again; merging by key in the
    touched partitions makes that harmless with the replacing engine."""
    store.create_tableset(schema)

    def each(batch: DataFrame, _: int) -> None:
        store.insert_h3dataframe_into_tableset(schema, batch, options)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
