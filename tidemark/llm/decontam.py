"""Benchmark decontamination by SimHash windows and Hamming blocks (operator 1).

Every window of a document that has as many words as an item gets a fingerprint: 64 signs of the sums of its
5-word shingles' hash bits.  A fingerprint is cut into four blocks, each with a number of bits that may differ; as these numbers, each
plus one, add up to more than the radius, of two fingerprints within it at least one block differs in no more, so that tables from a
block's value to the items near it give all candidates.  Those within the radius are verified by the exact similarity of the weighted shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, lean, saved, word_blocks
from .mixing import word_count

SHINGLE = 5
BITS, BLOCKS = 64, 4
BLOCK_BITS = BITS // BLOCKS
#: Windows of a size whose fingerprints are made at a time, so that the sums stay in the cache.
AT_ONCE = 4096
#: Windows of a size that are looked up at a time, so that its tables are.
SPAN = 1 << 16


def bit_signs(keys: np.ndarray) -> np.ndarray:
    """Each key's 64 bits as +1 and -1."""
    bits = np.unpackbits(np.ascontiguousarray(keys).view(np.uint8), bitorder="little").reshape(-1, BITS)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


class Sums:
    """Running sums of the signs of a block's shingles, from which windows of any size have their fingerprints."""

    def __init__(self, keys: np.ndarray):
        self._signs = bit_signs(keys)
        self._running: dict[type, np.ndarray] = {}
        self._gap: np.ndarray | None = None

    def _sums(self, size: int) -> np.ndarray:
        """Sums modulo the range of the smallest type that holds the sum of a window."""
        kind = np.int8 if size < 128 else np.int16 if size < 1 << 15 else np.int32
        if kind not in self._running:
            running = np.zeros((len(self._signs) + 1, BITS), kind)
            np.cumsum(self._signs, axis=0, dtype=kind, out=running[1:])
            self._running[kind] = running
        return self._running[kind]

    def windows(self, size: int, most: int | None = None) -> np.ndarray:
        """Fingerprints of all windows of so many shingles, by their start; of the first ``most``.  A bit is set where its sum is positive."""
        running = self._sums(size)
        n = max(0, len(running) - size)
        n = n if most is None else min(n, most)
        # the same memory for all sizes stays in the cache
        if self._gap is None or self._gap.dtype != running.dtype or len(self._gap) < n:
            self._gap, self._positive = np.empty((n, BITS), running.dtype), np.empty((n, BITS), bool)
        np.subtract(running[size : size + n], running[:n], out=self._gap[:n])
        np.greater(self._gap[:n], 0, out=self._positive[:n])
        return np.packbits(self._positive[:n].reshape(-1), bitorder="little").view(np.uint64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller by sum of the larger weights; a shingle weighs as often as it occurs."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


@dataclass
class Index:
    """Fingerprints of items, found by any block of their bits.

    For each size of item and each block a table from the block's value to the items whose block differs from it in few
    bits, as the bits of a number; 64 items share a table.
    """

    ids: list
    shingles: list[np.ndarray]
    least: float = 0.75
    radius: int = 17
    prints: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.prints = np.concatenate([Sums(s).windows(len(s)) for s in self.shingles] or [np.zeros(0, np.uint64)])
        self.sizes = np.array([len(s) for s in self.shingles], np.int64)
        self.known = np.unique(np.concatenate(self.shingles or [np.zeros(0, np.uint64)]))
        # whether any known shingle ends in these bits
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.known & np.uint64(0xFFFF)).astype(np.intp)] = True
        self.holders = [np.searchsorted(self.known, np.unique(x)) for x in self.shingles]
        # bits that may differ in each block: each plus one, they add up to the radius plus one
        self.changed = [(self.radius + 1 + i) // BLOCKS - 1 for i in range(BLOCKS)][::-1]
        self._tables: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    @property
    def tables(self) -> dict[int, list[tuple[np.ndarray, list[np.ndarray]]]]:
        """Size of items -> groups of up to 64 items (their places, a table for each block); built where they are needed."""
        if self._tables is None:
            values = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
            self._tables = {}
            for size in np.unique(self.sizes).tolist():
                own = np.flatnonzero(self.sizes == size)
                for group in np.array_split(own, -(-len(own) // 64)):
                    kind = np.uint8 if len(group) <= 8 else np.uint16 if len(group) <= 16 else np.uint32 if len(group) <= 32 else np.uint64
                    parts = self.prints[group].view(np.uint16).reshape(-1, BLOCKS)
                    found = [np.zeros(len(values), kind) for _ in range(BLOCKS)]
                    for i, row in enumerate(parts):
                        for table, value, changed in zip(found, row, self.changed):
                            table |= (np.bitwise_count(values ^ value) <= changed).astype(kind) << kind(i)
                    self._tables.setdefault(size, []).append((group, found))
        return self._tables

    def near(self, size: int, fingerprints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each item of this size, which of the fingerprints are within the radius."""
        blocks = fingerprints.view(np.uint16).reshape(-1, BLOCKS).T.astype(np.intp)
        for group, tables in self.tables[size]:
            mask = tables[0].take(blocks[0], mode="clip")
            for i in range(1, BLOCKS):
                mask |= tables[i].take(blocks[i], mode="clip")
            some = np.flatnonzero(mask != 0)
            mask, prints = mask[some], fingerprints[some]
            for i, item in enumerate(group.tolist()):
                if len(group) <= 16:
                    # of few items it is cheaper to look at all that any of them may be near to
                    yield item, some[np.bitwise_count(prints ^ self.prints[item]) <= self.radius]
                else:
                    at = np.flatnonzero(mask & mask.dtype.type(1 << i))
                    yield item, some[at[np.bitwise_count(prints[at] ^ self.prints[item]) <= self.radius]]

    def search(self, words: Words) -> dict[int, dict[int, tuple[float, int, int]]]:
        """Document of a block -> item's place -> (similarity, first word in the document, words) of its best window."""
        key, at = words.windows(SHINGLE)
        if not len(key) or not len(self.known):
            return {}
        doc = words.doc[at]
        cuts = np.searchsorted(doc, np.arange(len(words.rows) + 1))
        held = np.diff(cuts)
        near: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        largest = int(self.sizes.max())
        step = max(AT_ONCE, 4 * largest)
        for first in range(0, len(key), SPAN):
            last = min(first + SPAN, len(key))
            made: dict[int, list[np.ndarray]] = {size: [] for size in self.tables}
            for lo in range(first, last, step):
                sums = Sums(key[lo : min(lo + step, last) + largest])
                for size, parts in made.items():
                    parts.append(sums.windows(size, min(step, last - lo)))
            for size, parts in made.items():
                for item, start in self.near(size, np.concatenate(parts)):
                    if len(start):
                        near.setdefault(item, []).append((first + start, np.full(len(start), size)))
        # documents of fewer words than an item are one window; much shorter ones can't be similar
        short = np.flatnonzero((held > 0) & (held < largest) & (held >= self.least * self.sizes.min()))
        prints = np.concatenate([Sums(key[a:b]).windows(b - a) for a, b in zip(cuts[short].tolist(), cuts[short + 1].tolist())] or [np.zeros(0, np.uint64)])
        for size in self.tables:
            fits = np.flatnonzero((held[short] < size) & (held[short] >= self.least * size))
            for item, which in self.near(size, prints[fits]) if len(fits) else ():
                whole = short[fits[which]]
                near.setdefault(item, []).append((cuts[whole], held[whole]))
        # how many of the shingles up to a place any item has: bounds the similarity of a candidate
        maybe = np.flatnonzero(self.gate[(key & np.uint64(0xFFFF)).astype(np.intp)])
        place = np.searchsorted(self.known, key[maybe]).clip(max=len(self.known) - 1)
        sure = self.known[place] == key[maybe]
        where, which = maybe[sure], place[sure]
        met = np.zeros(len(key) + 1, np.int64)
        met[where + 1] = 1
        met = np.cumsum(met)
        share = self.least / (1 + self.least)
        found: dict[int, dict[int, tuple[float, int, int]]] = {}
        for item in sorted(near):
            start, width = map(np.concatenate, zip(*near[item]))
            size = int(self.sizes[item])
            fits = (doc[start] == doc[start + width - 1]) & (met[start + width] - met[start] >= share * (width + size) - 1e-9)
            start, width = start[fits], width[fits]
            for d in np.unique(doc[start]).tolist():
                own = doc[start] == d
                best = self._best(key, where, which, item, start[own], width[own])
                if best:
                    found.setdefault(d, {})[item] = (best[0], best[1] - int(cuts[d]), best[2] + SHINGLE - 1)
        return found

    def _best(self, key: np.ndarray, where: np.ndarray, which: np.ndarray, item: int, start: np.ndarray, width: np.ndarray) -> tuple[float, int, int] | None:
        """(similarity, start, shingles) of the window that is most similar to an item, of equal ones the first; none below the least similarity."""
        shingles = self.shingles[item]
        # the item's shingles in a window bound its similarity: the highest bounds are verified first
        lo, hi = np.searchsorted(where, [start.min(), (start + width).max()])
        mine = where[lo:hi][np.isin(which[lo:hi], self.holders[item])]
        most = np.minimum(np.searchsorted(mine, start + width) - np.searchsorted(mine, start), len(shingles))
        bound = most / (width + len(shingles) - most)
        top = None
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < max(self.least, top[0] if top else 0.0):
                break
            first, n = int(start[k]), int(width[k])
            similar = weighted_jaccard(key[first : first + n], shingles)
            if similar >= self.least and (top is None or (similar, -first) > (top[0], -top[1])):
                top = similar, first, n
        return top


def indexes(items: DataFrame, least: float = 0.75, block_words: int = 60_000) -> Iterator[Index]:
    """Indexes over (item_id, text), each of about ``block_words`` words, so that a set of any size fits.

    An item of fewer than five words has no shingle and matches nothing, as does a null one.
    """
    rows = items.select("item_id", "text").where("text is not null")
    total = rows.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    parts = max(1, -(-total // block_words))
    for part in range(parts):
        chosen = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        ids, shingles = [], []
        for words in word_blocks(pa.array([r[1] for r in chosen], pa.string()), lower=True):
            key, at = words.windows(SHINGLE)
            cut = np.searchsorted(words.doc[at], np.arange(len(words.rows) + 1))
            for d, row in enumerate(words.rows.tolist()):
                if cut[d + 1] > cut[d]:
                    ids.append(chosen[row][0])
                    shingles.append(key[cut[d] : cut[d + 1]].copy())
        if ids:
            yield Index(ids, shingles, least)


def find(docs: DataFrame, items: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window for each document and item it holds.

    Compared are windows of as many words as the item (the whole document where it is shorter), with A-Z
    lower-cased; of windows of one similarity the first counts.  ``first_word`` counts the document's words from 0.  Texts of any length are searched
    whole.  Null and empty texts hold nothing, repeated rows are reported each, items of equal texts each have their rows,
    and without items, or documents, the result is empty.  Other columns are not read.

    A pair at the least similarity is within the radius with a chance of 98 in 100, a more similar one more surely.  Items
    that need more than one index are searched one index after the other, each in a pass over the documents; only one is broadcast at a time.
    """
    rows = docs.select("doc_id", "text")
    doc_type, item_type = rows.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", item_type), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    parts, waiting = [], None
    for index in indexes(items, least):
        if waiting is not None:
            parts.append(saved(waiting))
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                picked, rest = [], []
                for words in word_blocks(batch.column(1), lower=True):
                    for d, hits in own.search(words).items():
                        for item, (similar, first, n) in sorted(hits.items()):
                            picked.append(int(words.rows[d]))
                            rest.append((own.ids[item], similar, first, n))
                columns = list(zip(*rest)) if rest else [[], [], [], []]
                arrays = [batch.column(0).take(pa.array(picked, pa.int64())), pa.array(columns[0], to_arrow_type(item_type)), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

        waiting = rows.mapInArrow(lean(run), schema)
    out = docs.sparkSession.createDataFrame([], schema) if waiting is None else waiting
    for part in parts:
        out = out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, least: float = 0.75) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    text_at = docs.columns.index("text")
    for index in indexes(items, least):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for words in word_blocks(batch.column(text_at), lower=True):
                    for d in own.search(words):
                        keep[words.rows[d]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
