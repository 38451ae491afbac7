"""Shard placement by a hierarchical weighted hash tree (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, running_offsets, saved

#: Rows that are placed at a time; bounds the temporary arrays.
AT_ONCE = 1 << 16
#: What tells the draws of one purpose from those of another.
TIME, RACK, SHARD, ACCEPT = 1, 2, 3, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Leaf:
    """One place for a shard: where it hangs in the tree, its weight, and the most that it may ever weigh."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0
    capacity: float = 1.0


def tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 3) -> list[Leaf]:
    """Shards 0 to ``shards`` - 1, filled into racks and racks into regions, in order.

    The last region's places that no shard has yet are there with a weight of 0, so that filling one changes no capacity.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    per_region = shards_per_rack * racks_per_region
    places = -(-shards // per_region) * per_region
    return [Leaf(i, i // per_region, i // shards_per_rack, float(i < shards)) for i in range(places)]


def _uniform(key: np.ndarray, *parts: object) -> np.ndarray:
    """Numbers above 0 and up to 1 that follow from a key and what they are for."""
    for part in parts:
        key = mix64((key ^ np.asarray(part, np.uint64)) * _STEP + _STEP)
    return ((key >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


@dataclass
class Placement:
    """The tree as arrays, and the descent.

    Keys arrive at a region at random times, at a rate of its capacity: the first time is a weighted hash draw of the region.
    The region with the earliest arrival is entered; of its racks the one with the least weighted draw for this arrival is, and of
    the rack's places again.  The place takes the key with the chance of its weight in its capacity, a hash draw too; if not, the region's next
    arrival comes, and the descent starts anew.  A region so takes a key at a rate of the weights below it.

    A draw depends on the key, the node and how often the region was tried, but on no weight.  So a weight that
    rises only lets its place accept keys on their way to others, one that falls only sends its own keys on, and what moves has
    one end in that place.  A node that is added or taken away, or whose capacity changes, does the same for its subtree.
    """

    leaves: list[Leaf]

    def __post_init__(self):
        if not any(x.weight > 0 for x in self.leaves):
            raise ValueError("no leaf has weight")
        if any(not 0 <= x.weight <= x.capacity for x in self.leaves):
            raise ValueError("a weight is from 0 to its leaf's capacity")
        self.regions = sorted({x.region for x in self.leaves if x.capacity > 0})
        inside: dict[int, dict[int, list[Leaf]]] = {r: {} for r in self.regions}
        for x in self.leaves:
            if x.capacity > 0:
                inside[x.region].setdefault(x.rack, []).append(x)
        self.racks = [sorted(inside[r].items()) for r in self.regions]
        self.rates = np.array([sum(x.capacity for _, rack in racks for x in rack) for racks in self.racks])
        self.live = [any(x.weight > 0 for _, rack in racks for x in rack) for racks in self.racks]

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Shard of each 64-bit key."""
        out = np.empty(len(keys), np.int64)
        for lo in range(0, len(keys), AT_ONCE):
            out[lo : lo + AT_ONCE] = self._place(keys[lo : lo + AT_ONCE])
        return out

    def _place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        tries = np.zeros((len(keys), len(self.regions)), np.uint64)
        times = np.empty(tries.shape)
        for i, region in enumerate(self.regions):
            # nothing below a region without weight accepts, so that it need not be tried
            times[:, i] = -np.log(_uniform(keys, TIME, region, 0)) / self.rates[i] if self.live[i] else np.inf
        open_ = np.arange(len(keys))
        while len(open_):
            first = times[open_].argmin(axis=1)
            for i, region in enumerate(self.regions):
                here = open_[first == i]
                if not len(here):
                    continue
                key, nth = keys[here], tries[here, i]
                out[here] = self._inside(i, key, nth)
                again = here[out[here] < 0]
                tries[again, i] += np.uint64(1)
                times[again, i] += -np.log(_uniform(keys[again], TIME, region, tries[again, i])) / self.rates[i]
            open_ = open_[out[open_] < 0]
        return out

    def _inside(self, i: int, key: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The shard that accepts the nth arrival at a region; -1 for none."""
        out = np.full(len(key), -1, np.int64)
        racks = self.racks[i]
        chosen = np.stack([-np.log(_uniform(key, RACK, name, nth)) / sum(x.capacity for x in rack) for name, rack in racks]).argmin(axis=0)
        for j, (_, rack) in enumerate(racks):
            at = np.flatnonzero(chosen == j)
            if not len(at):
                continue
            own, time = key[at], nth[at]
            leaf = np.stack([-np.log(_uniform(own, SHARD, x.shard, time)) / x.capacity for x in rack]).argmin(axis=0)
            weight = np.array([x.weight / x.capacity for x in rack])[leaf]
            shard = np.array([x.shard for x in rack])[leaf]
            taken = _uniform(own, ACCEPT, shard.astype(np.uint64), time) <= weight
            out[at[taken]] = shard[taken]
        return out


def place(key: Column, leaves: list[Leaf]) -> Column:
    """Shard of a key, by descending region, rack and shard.  A null key is placed as the text ``null``."""
    own = Placement(leaves)

    @F.pandas_udf("int")
    def placed(keys: pd.Series) -> pd.Series:
        return pd.Series(own.place(keys.to_numpy(np.int64).view(np.uint64)).astype(np.int32))

    return placed(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null"))))


def shard(docs: DataFrame, shards: int = 24, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of (doc_id, text).

    With ``carry`` all columns of docs come first, as the struct ``row``.
    A null text counts as empty: size 8 and checksum 0.  A null key has a place of
    its own; its rows' slots go by a hash of their texts.  Repeated rows get the same shard and different slots, whatever their length.  An empty
    table gives an empty result, other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.md5(F.concat(F.lit("null:"), text)))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        order.alias("_key"),
        place(F.col("doc_id"), tree(shards)).alias("shard"),
        place(F.col("doc_id"), tree(shards + 1)).alias("grown_shard"),
        F.lit(1).cast("bigint").alias("_one"),
        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry,
    )
    # whole rows are read again instead
    rows = rows if carry else saved(rows)
    slots = running_offsets(rows, ["shard"], "_key", ["_key", "doc_id", "text_crc32", "size"], "_one")
    return slots.select(*["row"] * carry, "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("before").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
