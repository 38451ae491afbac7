"""A stream of operations into a store: each micro-batch is one atomic batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(ops: DataFrame, store: Store, checkpoint: str, position: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of (key, op, value) to a store.

    A micro-batch that is delivered again after a restart is known by its id, which the manifest holds since the batch was
    published, and changes nothing.  ``position`` names the column that orders operations of one micro-batch on one key.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_pos", F.col(position).cast("int")) if position else batch
        store.append(rows, batch_id)

    writer = ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
