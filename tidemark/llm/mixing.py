"""Mixing sources to target weights (operator 4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, running_offsets, saved


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, take ``weights`` in turn.  ``share`` (a fraction)
    of all sizes is dealt by weight, and what exceeds ``most`` times a source's size is
    dealt again among the others: the sources whose size is smallest for their weight
    are full first, so that the fixed point is found by one sorted pass.  Only the list of
    sources, never a row of theirs, meets in the window.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ranked) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("bigint")
    s = sizes.withColumn("w", weight)
    up = Window.orderBy((F.col("source_size") / F.col("w")), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.select(
        "source", "source_size", "w",
        F.coalesce(F.sum("source_size").over(up), F.lit(0)).alias("full_size"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up), F.lit(0))).alias("open_w"),
        F.sum("source_size").over(everything).alias("all_size"),
    )
    p, q = share
    # what the open sources share, q times over, so that it stays a whole number
    s = s.withColumn("open_q", F.lit(p) * F.col("all_size") - F.lit(q * most) * F.col("full_size"))
    s = s.withColumn("full", F.col("w") * F.col("open_q") > F.lit(q * most) * F.col("source_size") * F.col("open_w"))
    first = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("open_q").alias("q"), F.col("open_w").alias("w")))).over(everything)
    s = s.withColumn("level", first)
    target = F.when(F.col("full"), F.lit(float(most)) * F.col("source_size")).otherwise(F.col("w") * F.col("level.q") / (F.lit(float(q)) * F.col("level.w")))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _key() -> Column:
    return F.coalesce(F.md5(F.col("doc_id").cast("string")), F.md5(F.concat(F.lit("null:"), F.coalesce("text", F.lit("")))))


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, _key and ``more``: a hash of doc_id, or of the text where that is null, that orders the rows of a source."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key().alias("_key"), *more)


def _goals(rows: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return targets(sizes, weights, share, most).select(F.col("source").alias("_source"), "source_size", "target")


def _placed(rows: DataFrame, goal: DataFrame, order: list[str]) -> DataFrame:
    """Each row with its source's size and target, the whole epochs and the words of a partial one that it gives."""
    placed = running_offsets(rows, ["source"], "_key", order, "size")
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor(F.col("target")).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("bigint")
    placed = placed.withColumn("epochs", epochs)
    rest = whole - F.col("epochs") * F.col("source_size")
    return placed.withColumn("partial", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("bigint"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of (doc_id, text, source).

    A source whose target is e times its size and a rest gets e whole epochs, and of
    one more epoch, in the order of a hash of doc_id, the rows up to the rest; the row at
    the cut gives the words that are missing, so that a source's taken words are its
    target rounded down.  A null or empty text has size 0, a null source is a source
    of its own, a row with a null doc_id goes by a hash of its text; repeated rows count each.  Texts of any length are counted whole,
    once.  An empty table gives an empty result; other columns are not read.
    """
    rows = saved(_rows(docs))
    placed = _placed(rows, _goals(rows, weights, share, most), ["_key", "doc_id", "size"])
    taken = (F.col("epochs") * F.col("size") + F.col("partial")).cast("bigint")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of the mix, with the columns of docs: a row for each epoch that takes it.

    The one row of a source at the cut has the text's first words, as many as are taken, with one space between them, and
    their number of characters in ``n_chars`` if there is such a column.  Rows without words are left out.  Of rows of one
    doc_id and size a digest of the text tells which comes first, of repeated ones the other columns.

    The cut of each source is found on ids, sizes and digests alone; whole rows are only compared with it, and not shuffled unless there are more than
    ``broadcast_rows`` sources.
    """
    text_digest = F.md5(F.coalesce("text", F.lit(""))).alias("_digest")
    order = ["_key", "doc_id", "size", "_digest"]
    rows = saved(_rows(docs, text_digest))
    goal = _goals(rows, weights, share, most)
    placed = _placed(rows, goal, order).withColumn("_at", F.struct(*order)).select("source", "_at", "size", "before", "partial", "epochs", "target", "source_size")
    placed = saved(placed)
    rest = F.floor("target").cast("bigint") - F.col("epochs") * F.col("source_size")
    edges = placed.where((F.col("size") > 0) & (F.col("before") + F.col("size") > rest)).groupBy("source").agg(F.min("_at").alias("_edge"), F.first("epochs").alias("_epochs"))
    edges = edges.withColumnRenamed("source", "_source")
    # what the rows at the cut, which are several where a row is repeated, give of the partial epoch
    given = placed.join(edges, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("_at") == F.col("_edge"))
    given = given.groupBy("_source", "_edge", "_epochs").agg(F.sum("partial").alias("_given"))
    given = saved(given)
    # one row for each source
    given = F.broadcast(given) if given.count() <= broadcast_rows else given
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text", _key().alias("_key"))
    every = own.join(given, F.col("source").eqNullSafe(F.col("_source")))
    edge = F.col("_edge._key")
    # a row of another key than the one at the cut is taken whole or not at all, so that its words need no count
    plain = every.where((F.col("_key") != edge) & F.col("text").rlike(WORD_PATTERN))
    plain = plain.select("_row", "_epochs", F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("partial"), (F.col("_key") < edge).alias("_more"))
    near = every.where(F.col("_key") == edge).select("_row", "doc_id", "_key", "_source", word_count(F.col("text")).alias("size"), text_digest, "_edge", "_epochs", "_given")
    near = near.where("size > 0").withColumn("_at", F.struct(*order))
    nth = F.row_number().over(Window.partitionBy("_source", "_at").orderBy(F.to_json("_row")))
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_given") - (nth - 1) * F.col("size")))
    partial = F.when(F.col("_at") == F.col("_edge"), left).when(F.col("_at") < F.col("_edge"), F.col("size")).otherwise(F.lit(0)).cast("bigint")
    near = near.withColumn("partial", partial).select("_row", "_epochs", "size", "partial", (F.col("partial") > 0).alias("_more"))
    taken = plain.union(near).withColumnRenamed("_epochs", "epochs")
    times = (F.col("epochs") + F.col("_more").cast("bigint")).cast("int")
    copies = taken.where(times > 0).select("_row", "epochs", "size", "partial", F.explode(F.sequence(F.lit(1), times)).alias("epoch"))
    short = (F.col("epoch") > F.col("epochs")) & (F.col("partial") < F.col("size"))
    copies = copies.withColumn("_cut", F.when(short, F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.col("partial").cast("int")), " ")))

    def column(name: str) -> Column:
        own = F.col("_row")[name]
        if name == "text":
            return F.coalesce("_cut", own).alias(name)
        if name == "n_chars":
            return F.coalesce(F.length("_cut").cast(docs.schema[name].dataType), own).alias(name)
        return own.alias(name)

    return copies.select(*[column(c) for c in docs.columns])
