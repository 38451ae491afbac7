"""Blocked Bloom filters: the bits of a key are all in one block of 512 bits."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import FormatError
from .checksum import xxh3, xxh3_of

#: Fixed values of the format: magic, version, bytes of the header and of a block.
MAGIC, VERSION, HEADER, BLOCK_BYTES = 0xB1000F11, 1, 16, 64
BLOCK_BITS = 8 * BLOCK_BYTES
#: Multipliers that make the second hash of the upper half.
SPREAD, MIX = 0x9E3779B9, 0x85EBCA6B
_LOW = 0xFFFFFFFF


def block_count(keys: int, bits_per_key: int = 10) -> int:
    return max(1, -(-max(keys, 1) * bits_per_key // BLOCK_BITS))


def block_of(digest: int, blocks: int) -> int:
    return (digest & _LOW) * blocks >> 32


def bits_of(digest: int, hashes: int) -> list[int]:
    high = digest >> 32
    step = high * SPREAD & _LOW
    step = (step ^ step >> 16) * MIX & _LOW
    return [(high + i * step) % BLOCK_BITS for i in range(hashes)]


@dataclass
class BlockedBloom:
    """A filter on the driver, for one run; ``build`` and ``probe`` do the same on DataFrames."""

    blocks: np.ndarray
    hashes: int = 8
    bits_per_key: int = 10
    keys: int = 0
    pruned: int = 0

    @classmethod
    def sized(cls, keys: int, bits_per_key: int = 10, hashes: int = 8) -> BlockedBloom:
        if not 1 <= hashes <= 16:
            raise ValueError("1 to 16 hashes")
        return cls(np.zeros((block_count(keys, bits_per_key), BLOCK_BYTES), np.uint8), hashes, bits_per_key)

    def insert(self, key: bytes) -> None:
        digest = xxh3(key)
        block = self.blocks[block_of(digest, len(self.blocks))]
        for bit in bits_of(digest, self.hashes):
            block[bit // 8] |= 1 << bit % 8
        self.keys += 1

    def contains(self, key: bytes) -> bool:
        """False is certain, true is probable."""
        digest = xxh3(key)
        block = self.blocks[block_of(digest, len(self.blocks))]
        found = all(block[bit // 8] >> bit % 8 & 1 for bit in bits_of(digest, self.hashes))
        self.pruned += not found
        return found

    @property
    def num_blocks(self) -> int:
        return len(self.blocks)

    @property
    def byte_size(self) -> int:
        return self.blocks.size

    def encode(self) -> bytes:
        return struct.pack("<IBBBBII", MAGIC, VERSION, self.hashes, self.bits_per_key, 0, len(self.blocks), self.keys) + self.blocks.tobytes()

    @classmethod
    def decode(cls, data: bytes) -> BlockedBloom:
        if len(data) < HEADER:
            raise FormatError("the filter is shorter than its header")
        magic, version, hashes, bits, _, blocks, keys = struct.unpack_from("<IBBBBII", data)
        if magic != MAGIC or version != VERSION:
            raise FormatError("not a filter of this version")
        if not 1 <= hashes <= 16 or not blocks:
            raise FormatError("the filter's parameters are out of range")
        if len(data) != HEADER + blocks * BLOCK_BYTES:
            raise FormatError("the filter's length does not match its blocks")
        return cls(np.frombuffer(data, np.uint8, offset=HEADER).reshape(blocks, BLOCK_BYTES).copy(), hashes, bits, keys)


def _block(digest: Column, blocks: int) -> Column:
    return F.call_function("shiftrightunsigned", digest.bitwiseAND(F.lit(_LOW)) * F.lit(blocks), F.lit(32))


def _times(x: Column, factor: int) -> Column:
    """The low 32 bits of the product of two 32-bit numbers, without overflow."""
    upper = (x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)
    return (upper + x * F.lit(factor & 0xFFFF)).bitwiseAND(F.lit(_LOW))


def _bit(digest: Column, i: Column) -> Column:
    high = F.call_function("shiftrightunsigned", digest, F.lit(32))
    step = _times(high, SPREAD)
    step = _times(step.bitwiseXOR(F.shiftright(step, 16)), MIX)
    return (high + i * step).bitwiseAND(F.lit(BLOCK_BITS - 1))


def build(keys: DataFrame, key: str, blocks: int, hashes: int = 8) -> DataFrame:
    """(block, word, bits): the filter as 64-bit words, of the blocks that have any bit; by expressions but for the hash."""
    digest = keys.select(xxh3_of(F.col(key)).alias("digest"))
    places = digest.select(_block(F.col("digest"), blocks).alias("block"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: _bit(F.col("digest"), i.cast("long")))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    return places.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits"))


def probe(keys: DataFrame, key: str, filter_words: DataFrame, blocks: int, hashes: int = 8) -> DataFrame:
    """keys with ``maybe``: false where the filter excludes the key."""
    words = filter_words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_words"))
    asked = keys.withColumn("_digest", xxh3_of(F.col(key))).withColumn("block", _block(F.col("_digest"), blocks))
    bits = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: _bit(F.col("_digest"), i.cast("long")))
    held = F.forall(bits, lambda b: F.call_function("shiftrightunsigned", F.coalesce(F.element_at("_words", F.shiftright(b, 6)), F.lit(0).cast("long")), (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return asked.join(words, "block", "left").withColumn("maybe", F.coalesce(held, F.lit(False))).drop("block", "_digest", "_words")
