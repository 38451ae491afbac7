"""Exact Jaccard self-join of word shingles, size-aware and heavy-light (operator 10).

A document's set holds the hashes of its distinct 5-word shingles.  With all elements in
one order, two sets of a Jaccard similarity of t or more share one of the first
``n - ceil(t * n) + 1`` elements of each, and two of the first
``n - ceil(t * n) + 2``.  Small sets enumerate the 2-subsets of the latter, which are
rare; large sets scan the inverted lists of the former; the boundary is the cheapest for
the sizes at hand.  Frequent elements stand last in the order, the less frequent ones
first, so that a passage that many documents share seldom makes a candidate.  Lists of
frequent elements are paired too, from the shortest on, as long as their pairs are not
many more than signatures; blocks of whole sets settle the longer ones.

Equal sets are one class from the start.  Sets that share a minimum of one of a few hash
functions are linked to the first of them, where an exact test agrees; pairs within a
component that is known by then aren't looked at again, so that a group of
copies is never compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, connected_components, lean, mix64, saved, signed, stored, temporaries, word_blocks
from .covertree import Links

SHINGLE = 5
MINIMA = 5
#: Rows of a key beyond which it is settled as a frequent one.
LONGEST = 48
_TOP = np.uint64(1 << 63)
_KEY = np.uint64((1 << 48) - 1)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, element) of a block, by document, each element once; ascending by element."""
    key, at = words.windows(SHINGLE)
    doc = words.doc[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for n in range(1, SHINGLE):
            own, start = words.windows(n, salt=n)
            pick = np.flatnonzero(counts[short] == n)
            whole[pick] = own[np.searchsorted(start, words.first[short[pick]])]
        doc, key = np.concatenate([doc, short]), np.concatenate([key, whole])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    if len(key):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        doc, key = doc[new], key[new]
    return doc, key


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def summaries(docs: DataFrame, local: int = 3, counters: int = 1 << 19) -> DataFrame:
    """Rows of two kinds: for each document (id, n, d1, d2, m1..), where the d are a digest of the set and the m its
    minima; and, with a null n, for each element that ``local`` or more documents of a task have, (d1, m1) = (element, how many).

    A task counts at most ``counters`` elements at a time: beyond that those seen once are forgotten, then the least frequent ones.  The counts decide
    only which elements are settled as frequent from the start; long lists of others are found by ``light_pairs``.
    """
    schema = "id long, n long, d1 long, d2 long, " + ", ".join(f"m{i} long" for i in range(MINIMA))
    names = ["id", "n", "d1", "d2", *[f"m{i}" for i in range(MINIMA)]]
    kinds = [pa.int64()] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        counted = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold(counted, seen):
            key, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            both = np.concatenate([counted[0], key])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([counted[1], n])[order]
            first = _runs(both)
            both, n = both[first], np.add.reduceat(n, first) if len(first) else n
            if len(both) > counters:
                both, n = both[n > 1], n[n > 1]
            if len(both) > counters:
                top = np.sort(np.argpartition(-n, counters)[:counters])
                both, n = both[top], n[top]
            return both, n

        for batch in batches:
            for words in word_blocks(batch.column(1), lower=True):
                doc, key = shingle_sets(words)
                size = np.bincount(doc, minlength=len(words.rows))
                out = np.zeros((2 + MINIMA, len(words.rows)), np.uint64)
                if len(key):
                    first, full = _runs(doc), size > 0
                    for i in range(2):
                        out[i, full] = np.add.reduceat(mix64(key ^ np.uint64(0xC2B2AE3D27D4EB4F * (i + 1) % (1 << 64))), first)
                    for i in range(MINIMA):
                        out[2 + i, full] = np.minimum.reduceat(mix64(key + np.uint64(0x165667B19E3779F9 * (2 * i + 1) % (1 << 64))), first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(words.rows)), pa.array(size.astype(np.int64)), *[pa.array(signed(x)) for x in out]], names)
                seen.append(key)
                if sum(map(len, seen)) > counters:
                    counted, seen = fold(counted, seen), []
        key, n = fold(counted, seen)
        key, n = key[n >= local], n[n >= local]
        for lo in range(0, len(key), 1 << 16):
            part = signed(key[lo : lo + (1 << 16)])
            blank = pa.nulls(len(part), pa.int64())
            columns = [blank, blank, pa.array(part), blank, pa.array(n[lo : lo + (1 << 16)]), *[blank] * (MINIMA - 1)]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names)

    return docs.select("id", "text").mapInArrow(lean(run), schema)


def frequent(rows: DataFrame, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Elements and how often they were counted; at most ``most``, the most frequent ones, ascending by element.

    The order of elements decides only what the join costs, not what it finds, so that a bound is harmless.
    """
    counts = rows.where("n is null").groupBy(F.col("d1").alias("e")).agg(F.sum("m0").alias("c"))
    # classes of counts, eight for each doubling, from the top as long as all of a class fits
    level = F.floor(8 * F.log2("c"))
    least, room = None, most
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    found = counts.where(level >= least if least is not None else F.lit(False)).toArrow()
    element = found.column("e").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(element)
    return element[order], found.column("c").to_numpy().astype(np.int64)[order]


def boundary(sizes: list[tuple[int, int]], least: int, list_cost: int = 4, up_to: int = 64) -> int:
    """The largest set size whose 2-subsets are enumerated: the cheapest for (size, sets) pairs.

    A row of a subset costs 1, one of an inverted list ``list_cost``, as its list is longer.
    Sets of a size from which a large set may be reached have rows of both kinds.
    """

    def cost(b: int) -> int:
        total = 0
        for n, sets in sizes:
            prefix = n - -(-least * n // 100) + 1
            total += sets * (prefix * (prefix + 1) // 2) * (n <= b)
            total += sets * prefix * list_cost * (100 * n > least * b)
        return total

    return min(range(1, up_to + 1), key=lambda b: (cost(b), b))


def prefixes(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], small: int, least: int) -> DataFrame:
    """(key, id, comp, n, hot, deal) of the sets' signatures; those whose elements are frequent are ``hot``, and dealt by document instead of key."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    names = ["key", "id", "comp", "n", "hot", "deal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements, counts = shared.value
        for batch in batches:
            ids, comps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for words in word_blocks(batch.column(2), lower=True):
                doc, key = shingle_sets(words)
                if not len(key):
                    continue
                rank = key >> np.uint64(1)
                if len(elements):
                    at = np.searchsorted(elements, key).clip(max=len(elements) - 1)
                    often = elements[at] == key
                    rank[often] = _TOP | (counts[at[often]].astype(np.uint64) << np.uint64(32)) | (key[often] >> np.uint64(32))
                order = np.lexsort((key, rank, doc))
                key, rank = key[order], rank[order]
                size = np.bincount(doc, minlength=len(words.rows))
                first = np.cumsum(size) - size
                nth = np.arange(len(key)) - first[doc]
                n = size[doc]
                prefix = n - -(-least * n // 100) + 1
                keys, owners, frequent_ = [], [], []
                pick = np.flatnonzero((nth < prefix) & (100 * n > least * small))
                keys.append(mix64(key[pick]) & _KEY)
                owners.append(doc[pick])
                frequent_.append(rank[pick] >= _TOP)
                little = (n <= small) & (n > 1)
                for gap in range(1, small):
                    pick = np.flatnonzero(little & (nth + gap <= prefix) & (nth + gap < n))
                    if not len(pick):
                        break
                    keys.append(mix64(key[pick] * np.uint64(0x9E3779B97F4A7C15) ^ key[pick + gap]) & _KEY)
                    owners.append(doc[pick])
                    frequent_.append(rank[pick] >= _TOP)
                often, owner, key = (np.concatenate(x) for x in (frequent_, owners, keys))
                row = words.rows[owner]
                deal = np.where(often, mix64(ids[row].astype(np.int64).view(np.uint64)) & _KEY, key)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(ids[row]), pa.array(comps[row]), pa.array(size[owner].astype(np.int64)), pa.array(often), pa.array(signed(deal))], names)

    return docs.select("id", "comp", "text").mapInArrow(lean(run), "key long, id long, comp long, n long, hot boolean, deal long")


def light_pairs(rows: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """(a, b, na, nb, hot): for each two rows of a key, of different components and of sizes that may be similar, a pair.

    Rows of frequent elements come out as they are: (key, id, comp, n), ``hot``.  So do those of a key that has more than ``longest`` rows without being
    known as frequent.  A task holds no more than ``longest`` rows of a key.
    """
    names = ["a", "b", "na", "nb", "hot"]

    def paired(done: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, doc, comp, n = done
        first = _runs(key)
        size = np.diff(np.append(first, len(key)))
        end = np.repeat(first + size, size)
        left = np.arange(len(key))
        for gap in range(1, longest):
            left = i = left[left + gap < end[left]]
            if not len(i):
                break
            j = i + gap
            fits = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]))
            i, j = i[fits], j[fits]
            if len(i):
                swap = doc[i] > doc[j]
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (doc[a], doc[b], n[a], n[b])], pa.array(np.zeros(len(a), bool))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot = np.zeros((4, 0), np.int64), None
        for batch in _with_end(batches):
            if batch is not None:
                often = batch.column(4).to_numpy(zero_copy_only=False)
                if often.any():
                    yield pa.RecordBatch.from_arrays([batch.column(i).filter(batch.column(4)) for i in range(5)], names)
                rest = np.concatenate([rest, np.stack([batch.column(i).to_numpy()[~often] for i in range(4)])], axis=1)
            if not rest.shape[1]:
                continue
            # rows of the last key wait for the next batch, unless there are too many of them already
            last = int(np.searchsorted(rest[0], rest[0, -1], "left"))
            cut = rest.shape[1] if batch is None or rest.shape[1] - last > longest or rest[0, -1] == hot else last
            done, rest = rest[:, :cut], rest[:, cut:]
            if not done.shape[1]:
                continue
            first = _runs(done[0])
            many = (np.diff(np.append(first, done.shape[1])) > longest) | (done[0][first] == hot)
            if many[-1]:
                hot = done[0, -1]
            frequent_ = np.repeat(many, np.diff(np.append(first, done.shape[1])))
            if frequent_.any():
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(x)) for x in done[:, frequent_]], pa.array(np.ones(int(frequent_.sum()), bool))], names)
            yield from paired(done[:, ~frequent_])

    return rows.repartition(F.col("deal")).sortWithinPartitions("deal").drop("deal").mapInArrow(lean(run), "a long, b long, na long, nb long, hot boolean")


def by_length(rows: DataFrame, small: int, most: int, cap: int = 4096, broadcast_rows: int = 500_000) -> tuple[DataFrame, DataFrame, int]:
    """The (key, id, comp, n) of shorter and of longer lists, and the bound between them: lists up to it have no more than ``most`` pairs in all, and ``cap`` rows each.

    A list of one component has no pairs and is in neither.  A list that has a set of at most ``small`` elements counts as a longer one, as pairs of small
    sets are all verified, whatever else they share.
    """
    lists = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lists = saved(lists.where("lo <> hi").select("key", "rows", "least"))
    level = F.ceil(F.log2("rows")).cast("int").alias("level")
    sums = lists.where(F.col("least") > small).groupBy(level).agg(F.sum(F.expr("rows * (rows - 1) div 2")).alias("pairs")).collect()
    longest = 1
    for r in sorted(sums):
        most -= r["pairs"]
        if most < 0 or 1 << r["level"] > cap:
            break
        longest = 1 << r["level"]
    lists = F.broadcast(lists) if lists.count() <= broadcast_rows else lists
    rows = saved(rows.join(lists, "key"))
    shorter = (F.col("rows") <= longest) & (F.col("least") > small)
    return *(rows.where(x).select("key", "id", "comp", "n") for x in (shorter, ~shorter)), longest


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def heavy_links(rows: DataFrame, docs: DataFrame, least: int, block: int = 512, broadcast_rows: int = 500_000, wave_bytes: int = 1 << 28) -> DataFrame:
    """(a, b): a spanning forest of the links between sets that share a frequent element and are of different components.

    Sets that such elements connect are a family, cut by size into classes of which only neighbours can be similar, and into blocks.
    A component that fills a block has blocks of its own, which are not compared with each other: what a family costs grows with its copies
    times what differs from them, and with the square of the rest only.
    A task has two blocks with whole sets and counts their overlaps as a product of matrices, so that a family's pairs are
    compared but never written.  Pairs of blocks come in waves of at most ``wave_bytes``, or twice the bytes of all blocks, as a block
    travels once for each block that it meets; a wave's files are deleted before the next one's are written.
    """
    with temporaries() as keep:
        mixed = saved(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("first")).where("lo <> hi").select("key", "first"))
        # rows of a key that very many sets have stay where they are, unless there are very many such keys
        mixed = F.broadcast(mixed) if mixed.count() <= broadcast_rows else mixed
        ties = saved(rows.join(mixed, "key").select(F.col("first").alias("a"), F.col("id").alias("b"), "n", "comp"))
        family = connected_components(ties.select("a", "b")).withColumnRenamed("component", "family")
        sized = ties.groupBy(F.col("b").alias("node")).agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
        # sizes of neighbouring classes at most differ by the ratio that similar sets may have
        sized = saved(sized.join(family, "node").withColumn("class", F.floor(F.log("n") / F.log(F.lit(100 / least)))))
        own_blocks = sized.groupBy("family", "class", "comp").agg(F.count("*").alias("rows")).withColumn("whole", F.col("rows") >= block)
        pooled = own_blocks.where("not whole").groupBy("family", "class").agg(F.ceil(F.sum("rows") / block).alias("pool"))
        counts = own_blocks.join(pooled, ["family", "class"], "left").withColumn("parts", F.when(F.col("whole"), F.ceil(F.col("rows") / block)).otherwise(F.col("pool")))
        placed = sized.join(saved(counts.select("family", "class", "comp", "whole", "parts")), ["family", "class", "comp"])
        # blocks of one component are told by it, those of the pool by -1; a pooled component stays together
        only = F.when(F.col("whole"), F.col("comp")).otherwise(F.lit(-1)).alias("only")
        part = F.pmod(F.xxhash64(F.when(F.col("whole"), F.col("node")).otherwise(F.col("comp"))), F.col("parts")).alias("part")
        placed = placed.select("family", "class", only, part, F.col("node").alias("id"), "comp")
        own = docs.join(placed, "id").select("family", "class", "only", "part", "id", "comp", "text")

        def pack(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            ids, comps, sizes, sets = [], [], [], []
            for batch in group.to_batches():
                for words in word_blocks(batch.column(6), lower=True):
                    doc, key = shingle_sets(words)
                    sets.append(key)
                    sizes.append(np.bincount(doc, minlength=len(words.rows)))
                    ids.append(batch.column(4).to_numpy()[words.rows])
                    comps.append(batch.column(5).to_numpy()[words.rows])
            blob = lambda parts: pa.array([np.concatenate(parts).tobytes()], pa.binary())
            return pa.table({**{c: group.column(c).slice(0, 1) for c in ("family", "class", "only", "part")}, "ids": blob(ids), "comps": blob(comps), "sizes": blob(sizes), "sets": blob(sets)})

        blocks = own.groupBy("family", "class", "only", "part").applyInArrow(pack, "family long, class long, only long, part long, ids binary, comps binary, sizes binary, sets binary")
        blocks = saved(blocks.withColumn("block", F.xxhash64("family", "class", "only", "part")))
        fields = ["ids", "comps", "sizes", "sets"]
        size = sum((F.length(f) for f in fields), F.lit(0).cast("long")).alias("bytes")
        places = saved(blocks.select("family", "class", "only", "part", "block", size))
        left = places.select("family", F.col("class").alias("at"), F.col("class").alias("c1"), F.col("only").alias("o1"), F.col("part").alias("p1"), F.col("block").alias("b1"), F.col("bytes").alias("y1"))
        right = places.select("family", F.explode(F.array("class", F.col("class") - 1)).alias("at"), F.col("class").alias("c2"), F.col("only").alias("o2"), F.col("part").alias("p2"), F.col("block").alias("b2"), F.col("bytes").alias("y2"))
        pairs = left.join(right, ["family", "at"]).where("(c1 < c2 or struct(o1, p1) <= struct(o2, p2)) and (o1 <> o2 or o1 < 0)")
        pairs = saved(pairs.select("b1", "b2", (F.col("y1") + F.col("y2")).alias("bytes")))
        total, met = pairs.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
        once = places.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        waves = max(1, -(-total // max(wave_bytes, 2 * once)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    value = lambda f: np.frombuffer(batch.column(f)[k].as_py(), np.uint64 if f[:4] == "sets" else np.int64)
                    a, b = _linked(*[[value(f"{f}{s}") for f in fields] for s in (1, 2)], least)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        found = []
        for wave in range(waves):
            chosen = pairs.where(F.pmod(F.xxhash64("b1", "b2"), F.lit(waves)) == wave).select("b1", "b2")
            chosen = F.broadcast(chosen) if met <= broadcast_rows * waves else chosen
            one = blocks.select(F.col("block").alias("b1"), *[F.col(f).alias(f"{f}1") for f in fields]).join(chosen, "b1")
            two = blocks.select(F.col("block").alias("b2"), *[F.col(f).alias(f"{f}2") for f in fields])
            both = one.join(two.hint("merge"), "b2").select(*[f"{f}{s}" for s in (1, 2) for f in fields])
            found.append(saved(both.mapInArrow(lean(run), "a long, b long")))
        links = found[0]
        for more in found[1:]:
            links = links.union(more)
        return keep(links if waves == 1 else saved(links))


def _linked(one: list[np.ndarray], two: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a forest of the links between two blocks of (ids, comps, sizes, sets)."""
    both = np.intersect1d(one[3], two[3])
    matrices = []
    for _, _, sizes, sets in (one, two):
        at = np.searchsorted(both, sets).clip(max=max(0, len(both) - 1))
        met = both[at] == sets if len(both) else np.zeros(len(sets), bool)
        matrices.append((np.repeat(np.arange(len(sizes)), sizes)[met], at[met]))
    shared = np.zeros((len(one[0]), len(two[0])), np.int64)
    for lo in range(0, len(both), 4096):
        dense = []
        for (row, at), (ids, *_) in zip(matrices, (one, two)):
            part = (at >= lo) & (at < lo + 4096)
            m = np.zeros((len(ids), min(4096, len(both) - lo)), np.float32)
            m[row[part], at[part] - lo] = 1
            dense.append(m)
        shared += (dense[0] @ dense[1].T).astype(np.int64)
    union = one[2][:, None] + two[2][None, :] - shared
    near = (100 * shared >= least * union) & (one[1][:, None] != two[1][None, :])
    i, j = np.nonzero(near)
    names = np.unique(np.concatenate([one[0][i], two[0][j]]))
    links = Links(len(names))
    links.join(np.searchsorted(names, one[0][i]), np.searchsorted(names, two[0][j]))
    moved = np.flatnonzero(links.label != np.arange(len(names)))
    return names[moved], names[links.label[moved]]


def verified(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """The (a, b) whose sets are similar, by their whole texts."""
    one = docs.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = docs.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                texts = pa.array([batch.column(2)[i].as_py(), batch.column(3)[i].as_py()], pa.large_string())
                (words,) = word_blocks(texts, lower=True, block_bytes=1 << 62)
                doc, key = shingle_sets(words)
                x, y = key[doc == 0], key[doc == 1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def components(docs: DataFrame, least: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text).

    Two documents link when 100 * shared >= least * union of their sets; component_id is the
    smallest doc_id that links reach.  A null or empty text, or one without words, has size 0
    and is alone; one of fewer than five words has its whole sequence as its only shingle.  A
    row with a null doc_id takes no part: its component is null.  Rows of one doc_id are one
    document.  Texts of any length are read whole.  An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    with temporaries() as keep:
        with stored(summaries(docs)) as rows:
            hot = frequent(rows)
            known = rows.where("n is not null")
            sizes = [tuple(r) for r in known.where("n between 2 and 96").groupBy("n").count().collect()]
            classes = known.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("cls"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(MINIMA)])
            members = saved(known.where("n > 0 and id is not null").join(classes.select("d1", "d2", "cls"), ["d1", "d2"]).select("id", "cls"))
            minima = classes.select("cls", F.posexplode(F.array(*[f"m{i}" for i in range(MINIMA)])).alias("i", "m"))
            hubs = minima.groupBy("i", "m").agg(F.min("cls").alias("hub"), F.count("*").alias("k")).where("k > 1").select("i", "m", "hub")
            stars = saved(minima.join(hubs, ["i", "m"]).where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct())
            plain = keep(saved(known.select("id", "n")))
        near = saved(verified(stars, docs, least))
        early = connected_components(near)
        reps = members.where("id = cls").select("id").distinct()
        labelled = reps.join(early, reps["id"] == early["node"], "left").select("id", F.coalesce("component", "id").alias("comp"))
        small = boundary(sizes, least)
        own = docs.join(saved(labelled), "id").select("id", "comp", "text")
        # what the shorter ones of the frequent elements' and of the long lists have is paired as well, as far as pairs aren't many more than signatures
        most = plain.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (100 - least) // 200
        counted = light_pairs(prefixes(own, hot, small, least), least).groupBy("a", "b", "na", "nb", "hot").agg(F.count("*").alias("k"))
        with stored(counted) as counted:
            listed = counted.where("hot").select(F.col("a").alias("key"), F.col("b").alias("id"), F.col("na").alias("comp"), F.col("nb").alias("n"))
            shorter, heavy, longest = by_length(listed, small, most)
            more = light_pairs(shorter.withColumn("hot", F.lit(False)).withColumn("deal", F.col("key")), least, max(longest, 2))
            counted = counted.where("not hot").drop("hot").union(more.select("a", "b", "na", "nb", F.lit(1).cast("long").alias("k")))
            counted = counted.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
            # a pair that shares an element of the rest is settled by heavy_links; for the others all shared elements are counted,
            # and elements beyond the shorter prefix can't be more than what is left of that set
            beyond = [F.expr(f"{n} - ({n} - cast(ceil({least} * {n} / 100) as bigint) + 1)") for n in ("na", "nb")]
            needed = F.expr(f"{least} * (na + nb)") <= (F.col("k") + F.greatest(*beyond)) * (100 + least)
            little = F.expr(f"na <= {small} and nb <= {small}")
            candidates = saved(counted.where(needed | little).select("a", "b"))
        late = saved(verified(candidates, docs, least))
        firm = heavy_links(heavy, docs, least)
        links = near.union(late).union(firm).union(members.where("id <> cls").select(F.col("cls").alias("a"), F.col("id").alias("b")))
        found = keep(connected_components(links))
        out = plain.join(found, plain["id"] == found["node"], "left")
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
