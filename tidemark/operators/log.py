"""The change log: one row for each operation, under the sequence number of its batch.

``key`` and ``value`` are BINARY (or STRING, with the same order), ``op`` is 0 for a put and 1 for a
tombstone, whose value is empty.  ``seqno`` is a BIGINT, so that numbers of 2**63 and above are refused.
``batch_pos`` and ``run_id`` break ties: within a batch the last operation on a key counts,
and of two runs the newer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, TOMBSTONE = 0, 1
MAX_SEQNO = (1 << 63) - 1
LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seqno", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), False),
        T.StructField("batch_pos", T.IntegerType(), False),
        T.StructField("run_id", T.LongType(), False),
    ]
)


def newest_first(log: DataFrame) -> list:
    """Sort keys that put the version that counts first; ties by what the log has of batch_pos and run_id."""
    return [F.desc(c) for c in ("seqno", "batch_pos", "run_id") if c in log.columns]


def events_log(events: DataFrame, run_rows: int = 1250) -> DataFrame:
    """The table of events as a change log of users' last properties: an error deletes, anything else puts.

    Keys and values are text here; the order of the keys is that of their bytes.
    """
    deleted = F.col("event_type") == "error"
    return events.select(
        F.format_string("user-%010d", "user_id").alias("key"),
        (F.col("event_id") + 1).cast("long").alias("seqno"),
        F.when(deleted, TOMBSTONE).otherwise(PUT).cast("tinyint").alias("op"),
        F.when(deleted, F.lit("")).otherwise(F.col("props")).alias("value"),
        F.lit(0).alias("batch_pos"),
        F.expr(f"event_id div {run_rows}").cast("long").alias("run_id"),
    )


def batched(log: DataFrame, size: int) -> DataFrame:
    """The same operations in batches of ``size`` sequence numbers, each under one number."""
    return log.withColumn("batch_pos", ((F.col("seqno") - 1) % size).cast("int")).withColumn("seqno", F.expr(f"(seqno - 1) div {size} + 1"))
