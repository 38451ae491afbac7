"""Compaction, run statistics and block layout of a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .log import PUT, TOMBSTONE, newest_first
from .read import newest, with_neighbour


def compacted(runs: list[DataFrame]) -> DataFrame:
    """All records of the runs as one: every version and every tombstone is kept."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def with_intervals(log: DataFrame) -> DataFrame:
    """Each version with ``until``: the sequence number of the next version of its key, null for the newest.

    A version is the one that counts at snapshots from ``seqno`` up to, but without, ``until``.  Versions are sorted into ranges, so that
    those of one key may be in many of them.
    """
    order = [F.asc(c) for c in ("seqno", "batch_pos", "run_id") if c in log.columns]
    rows = with_neighbour(log.orderBy("key", *order), ["key", "seqno"], 1, "_next")
    return rows.withColumn("until", F.when(F.col("_next.key") == F.col("key"), F.col("_next.seqno"))).drop("_next")


def pruned(log: DataFrame, floor: int) -> DataFrame:
    """The versions that a snapshot at ``floor`` or above can see.

    A version goes when a newer one is at or below the floor; so does the newest version at the
    floor if it is a tombstone.  Reads below the floor change.  What is above the floor stays as it is; of the rest each map task
    keeps one row for a key before the shuffle.
    """
    above = log.where(F.col("seqno") > F.lit(floor))
    return above.unionByName(newest(log, floor).where(F.col("op") != TOMBSTONE))


def run_metadata(log: DataFrame) -> DataFrame:
    """Records, keys' and sequence numbers' bounds of each run."""
    return log.groupBy("run_id").agg(F.count("*").alias("records"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seqno").alias("min_seqno"), F.max("seqno").alias("max_seqno"))


def statistics(log: DataFrame) -> DataFrame:
    """One row: number of runs and newest sequence number."""
    return log.agg(F.countDistinct("run_id").alias("run_count"), F.coalesce(F.max("seqno"), F.lit(0)).alias("current_seqno"))


def live_counts(log: DataFrame) -> DataFrame:
    """Records by op."""
    return log.groupBy(F.when(F.col("op") == PUT, "put").otherwise("tombstone").alias("kind")).agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"))


def _placed(log: DataFrame) -> DataFrame:
    """The log with ``nth``, from 0, in its run, and ``before``, the key before it; by ranges, so that a run of any size is in many tasks."""
    ordered = log.orderBy("run_id", "key", *newest_first(log))
    rows = with_neighbour(ordered, ["run_id", "key"], -1, "_last", place="_place")
    starts = rows.groupBy("run_id").agg(F.min("_place").alias("_start"))
    rows = rows.join(starts, "run_id")
    before = F.when(F.col("_last.run_id") == F.col("run_id"), F.col("_last.key"))
    return rows.withColumn("nth", F.col("_place") - F.col("_start")).withColumn("before", before).drop("_last", "_place", "_start")


def block_index(log: DataFrame, records: int) -> DataFrame:
    """(run_id, block, records, last_key) of runs cut, in order, into blocks of so many records."""
    placed = _placed(log).withColumn("block", F.floor(F.col("nth") / records))
    return placed.groupBy("run_id", "block").agg(F.count("*").alias("records"), F.max("key").alias("last_key"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters (bytes of BINARY) that two values share."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.coalesce(F.array_min(same) - 1, n)


def prefix_compression(log: DataFrame, restart: int = 16) -> DataFrame:
    """(run_id, records, key_bytes, stored_bytes): what storing keys without the prefix shared with the one before saves.

    Every ``restart`` records a key is stored in full.
    """
    keys = _placed(log).select("run_id", "key", "before", (F.col("nth") % restart).alias("nth"))
    shared = F.when((F.col("nth") == 0) | F.col("before").isNull(), 0).otherwise(shared_prefix(F.col("before"), F.col("key")))
    sizes = keys.select("run_id", F.octet_length("key").alias("bytes"), shared.alias("shared"))
    return sizes.groupBy("run_id").agg(F.count("*").alias("records"), F.sum("bytes").alias("key_bytes"), F.sum(F.col("bytes") - F.col("shared")).alias("stored_bytes"))
