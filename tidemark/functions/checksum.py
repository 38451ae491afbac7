"""CRC32C and XXH3-64 over binary columns; Spark's crc32 and xxhash64 are other functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the reflected Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78

#: Tags of the algorithms.
CRC32C, XXH3 = 0, 1


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_TABLE = _table()
_ENTRIES = _TABLE.tolist()


def crc32c(data: bytes, before: int = 0) -> int:
    """Checksum of data; ``before`` is that of what precedes it."""
    table, crc = _ENTRIES, before ^ 0xFFFFFFFF
    for byte in data:
        crc = table[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """Checksums of many values, a byte of each at a time, the longest values first."""
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(values), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[order]
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    for t, k in enumerate(active.tolist()):
        part = crc[:k]
        crc[:k] = _TABLE[(part ^ data[begin[:k] + t]) & 0xFF] ^ part >> np.uint32(8)
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def xxh3(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


class Xxh3:
    """The same digest of bytes that come in parts."""

    def __init__(self):
        self._state = xxhash.xxh3_64()

    def update(self, part: bytes) -> Xxh3:
        self._state.update(part)
        return self

    def digest(self) -> int:
        return self._state.intdigest()


@F.pandas_udf(T.LongType())
def crc32c_of(values: pd.Series) -> pd.Series:
    """CRC32C of a BINARY column, 0 to 2**32 - 1; null stays null."""
    kept = values.dropna()
    return pd.Series(crc32c_many([bytes(v) for v in kept]).astype(np.int64), kept.index, "Int64").reindex(values.index)


@F.pandas_udf(T.LongType())
def xxh3_of(values: pd.Series) -> pd.Series:
    """XXH3-64 of a BINARY column, as the BIGINT of the same bits; null stays null."""
    kept = values.dropna()
    digests = np.array([xxh3(bytes(v)) for v in kept], np.uint64).view(np.int64)
    return pd.Series(digests, kept.index, "Int64").reindex(values.index)


def checksum_of(algorithm: Column, values: Column) -> Column:
    """The checksum that a tag names; null for an unknown tag."""
    return F.when(algorithm == CRC32C, crc32c_of(values)).when(algorithm == XXH3, xxh3_of(values))
