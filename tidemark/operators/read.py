"""Reads of a change log at a sequence number: points, batches of keys, ranges, pages.

The order of the steps is the semantics: versions above the snapshot go first, then all but the newest version of
each key, and only then the tombstones.  ``row_number() = 1`` becomes a window group limit, which keeps one row
for each key and map task before the shuffle, so that a key with very many versions is no hot spot.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .log import PUT, newest_first


@dataclass(frozen=True)
class Bound:
    """One end of a range; ``Bound()`` is unbounded."""

    key: object = None
    included: bool = True


def included(key: object) -> Bound:
    return Bound(key, True)


def excluded(key: object) -> Bound:
    return Bound(key, False)


UNBOUNDED = Bound()


def snapshot(log: DataFrame) -> int:
    """The newest sequence number; 0 for an empty log."""
    return log.agg(F.max("seqno")).first()[0] or 0


def at_snapshot(log: DataFrame, seqno: int | None = None) -> DataFrame:
    return log if seqno is None else log.where(F.col("seqno") <= F.lit(seqno))


def newest(log: DataFrame, seqno: int | None = None) -> DataFrame:
    """The version of each key that counts at a snapshot, tombstones too."""
    order = Window.partitionBy("key").orderBy(*newest_first(log))
    return at_snapshot(log, seqno).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def newest_by_max(log: DataFrame, seqno: int | None = None) -> DataFrame:
    """As ``newest``, by an aggregate with partial results."""
    ties = [c for c in ("seqno", "batch_pos", "run_id") if c in log.columns]
    rest = [c for c in log.columns if c not in ("key", *ties)]
    best = F.max_by(F.struct(*ties, *rest), F.struct(*ties)).alias("_best")
    return at_snapshot(log, seqno).groupBy("key").agg(best).select("key", "_best.*").select(*log.columns)


def visible(log: DataFrame, seqno: int | None = None) -> DataFrame:
    """key, value and seqno of what a reader sees, in no order."""
    return newest(log, seqno).where(F.col("op") == PUT).select("key", "value", "seqno")


def within(start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> Column:
    """The predicate of a range of keys; it is pushed to the scan."""
    key, test = F.col("key"), F.lit(True)
    if start.key is not None:
        test = key >= F.lit(start.key) if start.included else key > F.lit(start.key)
    if end.key is not None:
        test = test & (key <= F.lit(end.key) if end.included else key < F.lit(end.key))
    return test


def range_bounds(log: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, seqno: int | None = None) -> DataFrame:
    """Visible records between two bounds, ascending by key.  Bounds that cross give nothing."""
    return visible(log.where(within(start, end)), seqno).orderBy("key")


def key_range(log: DataFrame, start: object, end: object) -> DataFrame:
    """Half-open: start is included, end is not."""
    return range_bounds(log, included(start), excluded(end))


def scan_all(log: DataFrame, seqno: int | None = None) -> DataFrame:
    return range_bounds(log, seqno=seqno)


def after_prefix(prefix: bytes) -> bytes | None:
    """The least key above all keys of a prefix; none where there is no such key."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def after_text(prefix: str) -> str | None:
    """As ``after_prefix`` for text: code points sort as their UTF-8 bytes do, so that the last one that can be is raised."""
    kept = prefix.rstrip("\U0010ffff")
    if not kept:
        return None
    # surrogates are no characters
    return kept[:-1] + ("\ue000" if kept[-1] == "\ud7ff" else chr(ord(kept[-1]) + 1))


def prefix_scan(log: DataFrame, prefix: bytes | str, seqno: int | None = None) -> DataFrame:
    if isinstance(prefix, str):
        end = after_text(prefix)
    else:
        end = after_prefix(prefix)
    return range_bounds(log, included(prefix) if prefix else UNBOUNDED, excluded(end) if end else UNBOUNDED, seqno)


def get(log: DataFrame, key: object, seqno: int | None = None) -> DataFrame:
    """No row or one: the value of a key."""
    return visible(log.where(F.col("key") == F.lit(key)), seqno)


def multi_get(log: DataFrame, keys: DataFrame, seqno: int | None = None) -> DataFrame:
    """A row for each row of keys(key): value and seqno, null where the key isn't visible.

    The log is cut to the keys asked for before its versions are ranked; Spark picks the join by the keys' size.
    """
    asked = keys.select("key").distinct()
    found = visible(log.join(asked, "key", "left_semi"), seqno)
    return keys.select("key").join(found, "key", "left")


def page(log: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, limit: int = 1000, seqno: int | None = None, most: int = 10_000) -> DataFrame:
    """The first records of a range, each with ``truncated``: whether the range goes on.

    ``limit`` is cut to ``most``; a limit of 0 gives no record.
    """
    limit = max(0, min(limit, most))
    more = range_bounds(log, start, end, seqno).limit(limit + 1)
    order = Window.orderBy("key")
    ranked = more.withColumn("_nth", F.row_number().over(order)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return ranked.where(F.col("_nth") <= limit).drop("_nth")


def response(log: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, limit: int = 1000, seqno: int | None = None) -> DataFrame:
    """One row: ``records`` with keys and values in base64, and ``truncated``."""
    limit = max(0, min(limit, 10_000))
    more = range_bounds(log, start, end, seqno).limit(limit + 1)
    rows = F.array_sort(F.collect_list(F.struct(F.col("key").cast("binary").alias("k"), "value", "seqno")))
    cut = F.transform(F.slice("rows", 1, limit) if limit else F.slice("rows", 1, 0), lambda r: F.struct(F.base64(r["k"]).alias("key"), F.base64(r["value"].cast("binary")).alias("value"), r["seqno"].alias("seqno")))
    return more.agg(rows.alias("rows")).select(cut.alias("records"), (F.size("rows") > limit).alias("truncated"))


def history(log: DataFrame, key: object) -> DataFrame:
    """All versions of a key, newest first."""
    return log.where(F.col("key") == F.lit(key)).orderBy(*newest_first(log))


def from_base64(start: str | None, end: str | None) -> tuple[Bound, Bound]:
    """Bounds of a scan whose ends are base64 of bytes: the start is included, the end is not, and either may be missing."""
    lo, hi = (None if x is None else base64.b64decode(x, validate=True) for x in (start, end))
    return UNBOUNDED if lo is None else included(lo), UNBOUNDED if hi is None else excluded(hi)


def merged(runs: list[DataFrame]) -> DataFrame:
    """All records of the runs, newest run first in the list: by key, then newest first, then by run."""
    ranked = [r.withColumn("source_rank", F.lit(i)) for i, r in enumerate(runs)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.orderBy("key", F.desc("seqno"), "source_rank")


def _ranges(ordered: DataFrame) -> DataFrame:
    """The sorted rows, kept, with ``_part`` and ``_within``: the range partition of the sort, and the place in it from 0."""
    from ..sources.fs import checkpointed

    rows = checkpointed(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part, within_part = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).withColumn("_within", within_part).drop("_id")


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The place, from 1, of each row of a sorted DataFrame.

    Rows are numbered within the range partitions of the sort, and each partition starts at the sum of the sizes of those
    before it; the sorted rows are kept first, so that both passes see the same ranges.
    """
    rows = _ranges(ordered)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_within") + 1).drop("_part", "_within", "_start")


def with_neighbour(ordered: DataFrame, columns: list[str], step: int, name: str, place: str | None = None) -> DataFrame:
    """The rows of a sorted DataFrame, each with some columns of the row after it (step 1) or before it (-1) as a struct; null at the end.

    Neighbours are looked up within the range partitions of the sort; only one row of each partition is told to the next.  ``place`` adds the
    row's place from 1, as ``numbered`` does.
    """
    rows = _ranges(ordered)
    own = F.struct(*columns)
    within_part = Window.partitionBy("_part").orderBy("_within")
    rows = rows.withColumn("_near", F.lead(own).over(within_part) if step > 0 else F.lag(own).over(within_part))
    edge = F.min_by(own, "_within") if step > 0 else F.max_by(own, "_within")
    parts = rows.groupBy("_part").agg(edge.alias("_edge"), F.count("*").alias("_n"))
    # one row for each partition
    along = Window.orderBy("_part")
    other = F.lead("_edge").over(along) if step > 0 else F.lag("_edge").over(along)
    start = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(parts.select("_part", other.alias("_other"), start.alias("_start")), "_part")
    rows = rows.withColumn(name, F.coalesce("_near", "_other"))
    rows = rows if place is None else rows.withColumn(place, F.col("_start") + F.col("_within") + 1)
    return rows.drop("_part", "_within", "_near", "_other", "_start")
