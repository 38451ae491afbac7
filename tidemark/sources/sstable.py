"""Sorted-table files: checked blocks of prefix-compressed records, a filter and an index."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gcm, varint
from ..functions.batches import FormatError
from ..functions.bloom import BlockedBloom
from ..functions.checksum import crc32c
from ..functions.crypto import NONCE_TAG, SecretKey, run_key

#: Fixed values of the format.
MAGIC, FOOTER_MAGIC, VERSION = 0x53564B50, 0x4654525353564B50, 1
HEADER_REGION, HEADER, FOOTER, HANDLE = 4096, 64, 64, 16
BLOCK_TARGET, ALIGNMENT, RESTART = 16 * 1024, 4096, 16
CHECKSUMMED, ENCRYPTED = 1, 2


def file_name(number: int) -> str:
    """Name of a table file."""
    return f"{number:08d}.sst"


def parse_file_name(name: str) -> int | None:
    """The number of a table file; none for any other name, whose number may have any digits."""
    stem, dot, kind = name.partition(".")
    return int(stem) if dot and kind == "sst" and stem.isascii() and stem.isdigit() else None


def _place(table_id: int, offset: int) -> tuple[bytes, bytes]:
    """The nonce of a block, by its place in the file, and what binds it to the file and the place."""
    return struct.pack("<IQ", NONCE_TAG, offset), struct.pack("<QQ", table_id, offset)


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class BlockBuilder:
    def __init__(self):
        self.data, self.restarts, self.last, self.count = bytearray(), [], b"", 0

    def add(self, key: bytes, value: bytes, seqno: int, op: int) -> None:
        shared = 0
        if self.count % RESTART:
            shared = shared_prefix(self.last, key)
        else:
            self.restarts.append(len(self.data))
        for n in (shared, len(key) - shared, len(value)):
            self.data += varint.encode(n, 32)
        self.data += struct.pack("<QB", seqno, op) + key[shared:] + value
        self.last, self.count = key, self.count + 1

    def size(self) -> int:
        return len(self.data) + 4 * len(self.restarts) + 8

    def finish(self) -> bytes:
        out = bytes(self.data) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        return out + struct.pack("<I", crc32c(out))


@dataclass
class Block:
    """A block whose checksum and restarts hold."""

    data: bytes
    restarts: tuple[int, ...]

    @classmethod
    def open(cls, data: bytes) -> Block:
        if len(data) < 8:
            raise FormatError("the block is too short")
        count, crc = struct.unpack_from("<II", data, len(data) - 8)
        if crc != crc32c(data[:-4]):
            raise FormatError("the block's checksum differs")
        end = len(data) - 8 - 4 * count
        if end < 0:
            raise FormatError("the block has more restarts than bytes")
        restarts = struct.unpack_from(f"<{count}I", data, end)
        if any(r > end for r in restarts) or list(restarts) != sorted(restarts):
            raise FormatError("the block's restarts are out of order")
        return cls(data[:end], restarts)

    def records(self, at: int = 0) -> Iterator[tuple[bytes, int, int, bytes]]:
        """(key, seqno, op, value) from a restart on."""
        key = b""
        while at < len(self.data):
            sizes = []
            for _ in range(3):
                n, used = varint.decode(self.data, at, 32)
                sizes.append(n)
                at += used
            shared, rest, size = sizes
            if shared > len(key) or at + 9 + rest + size > len(self.data):
                raise FormatError("a record exceeds its block")
            seqno, op = struct.unpack_from("<QB", self.data, at)
            if op > 1:
                raise FormatError(f"unknown operation {op}")
            at += 9
            key = key[:shared] + self.data[at : at + rest]
            yield key, seqno, op, self.data[at + rest : at + rest + size]
            at += rest + size

    def seek(self, key: bytes) -> Iterator[tuple[bytes, int, int, bytes]]:
        """The records from the first with a key of at least ``key`` on."""
        lo, hi = 0, len(self.restarts)
        while lo < hi:
            mid = (lo + hi) // 2
            if next(self.records(self.restarts[mid]))[0] < key:
                lo = mid + 1
            else:
                hi = mid
        # versions of the key may stand before the restart that starts with it
        start = self.restarts[lo - 1] if lo else 0
        return (r for r in self.records(start) if r[0] >= key)


def write_table(records: Iterable[tuple[bytes, int, int, bytes]], block_size: int = BLOCK_TARGET, filter_keys: int | None = None, bits_per_key: int = 10, hashes: int = 8, key: SecretKey | None = None, table_id: int = 0) -> bytes:
    """A file of records in order of key, newest first.  ``filter_keys`` 0 leaves the filter out.

    With a master ``key`` the blocks of records are sealed under a key of the table's id; the filter and the index, which has the last key
    of each block, are plain.
    """
    own = run_key(key, table_id).material if key else b""
    rows = list(records)
    for a, b in zip(rows, rows[1:]):
        if (a[0], -a[1]) > (b[0], -b[1]):
            raise ValueError("records are out of order")
    expected = len(rows) if filter_keys is None else filter_keys
    bloom = BlockedBloom.sized(expected, bits_per_key, hashes) if expected else None
    body, index, builder, blocks = bytearray(HEADER_REGION), BlockBuilder(), BlockBuilder(), 0

    def seal() -> None:
        nonlocal builder, blocks
        data = builder.finish()
        checksum = data[-4:]
        if key:
            nonce, bound = _place(table_id, len(body))
            data, checksum = gcm.sealed(own, nonce, bound, data), bytes(4)
        handle = struct.pack("<QI", len(body), len(data)) + checksum
        index.add(builder.last, handle, 0, 0)
        body.extend(data + bytes(-len(data) % ALIGNMENT))
        builder, blocks = BlockBuilder(), blocks + 1

    for name, seqno, op, value in rows:
        builder.add(name, value, seqno, op)
        if bloom:
            bloom.insert(name)
        if builder.size() >= block_size:
            seal()
    if builder.count:
        seal()
    end = len(body)
    kept = bloom.encode() if bloom else b""
    handles = [struct.pack("<QII", end, len(kept), 0), struct.pack("<QII", end + len(kept), 0, 0)]
    data = index.finish()
    handles.insert(0, struct.pack("<QI", end + len(kept), len(data)) + data[-4:])
    footer = b"".join(handles) + struct.pack("<QI", FOOTER_MAGIC, VERSION)
    seqnos = [r[1] for r in rows] or [0]
    head = struct.pack("<IIIBBHQQQQQ", MAGIC, VERSION, CHECKSUMMED | (ENCRYPTED if key else 0), 0, 0, 0, len(rows), blocks, min(seqnos), max(seqnos), end)
    body[:HEADER] = head + struct.pack("<II", crc32c(head), 0)
    return bytes(body) + kept + data + footer + struct.pack("<I", crc32c(footer))


class Table:
    """A file of records; damage is an error, and so is a key where the blocks are plain, or none where they are sealed."""

    def __init__(self, data: bytes, key: SecretKey | None = None, table_id: int = 0):
        if len(data) < HEADER_REGION + FOOTER:
            raise FormatError("the file is too short")
        head, footer = data[:HEADER], data[-FOOTER:]
        magic, version, flags, compression, self.checksum_algorithm, reserved, self.entries, self.blocks, self.min_seqno, self.max_seqno, self.data_end, crc, last = struct.unpack("<IIIBBHQQQQQII", head)
        if magic != MAGIC or version != VERSION or reserved or last or crc != crc32c(head[:56]):
            raise FormatError("the header is damaged")
        if struct.unpack_from("<QI", footer, 48) != (FOOTER_MAGIC, VERSION) or struct.unpack_from("<I", footer, 60)[0] != crc32c(footer[:60]):
            raise FormatError("the footer is damaged")
        if bool(flags & ENCRYPTED) != (key is not None):
            raise FormatError("the file is encrypted, and no key is given" if key is None else "the file is not encrypted, and a key is given")
        self._key, self.table_id = run_key(key, table_id).material if key else None, table_id
        if compression:
            raise FormatError("compressed blocks are not supported")
        self.data = data
        at, size, _ = struct.unpack_from("<QII", footer, 0)
        self.index = [(key, *struct.unpack("<QII", value)) for key, _, _, value in Block.open(data[at : at + size]).records()]
        at, size, _ = struct.unpack_from("<QII", footer, 16)
        self.bloom = BlockedBloom.decode(data[at : at + size]) if size else None

    def block(self, i: int) -> Block:
        _, at, size, _ = self.index[i]
        data = self.data[at : at + size]
        return Block.open(data if self._key is None else gcm.opened(self._key, *_place(self.table_id, at), data))

    def scan(self) -> Iterator[tuple[bytes, int, int, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i).records()

    def get(self, key: bytes, seqno: int) -> tuple[int, int, bytes] | None:
        """(seqno, op, value) of the newest version at or below a number; versions may go on in the next block."""
        if self.bloom is not None and not self.bloom.contains(key):
            return None
        for i in range(bisect.bisect_left(self.index, key, key=lambda entry: entry[0]), len(self.index)):
            for k, s, op, value in self.block(i).seek(key):
                if k != key:
                    return None
                if s <= seqno:
                    return s, op, value
        return None


SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("seqno", T.LongType()), T.StructField("op", T.ByteType()), T.StructField("value", T.BinaryType()), T.StructField("error", T.StringType())])


def table_id(run: int, part: int) -> int:
    return run << 20 | part


def _shared(df: DataFrame, key: SecretKey | None):
    """A key on its way to the workers, in a broadcast variable."""
    return df.sparkSession.sparkContext.broadcast(key.material) if key else None


def tables(log: DataFrame, run: str = "run_id", file_bytes: int = 64 << 20, key: SecretKey | None = None, **options: int) -> DataFrame:
    """(run_id, part, table_id, content): the records of each run of a change log as table files of about so many bytes, in order of their keys."""
    import pyarrow as pa

    shared = _shared(log, key)

    rows = log.select(F.col(run).cast("long").alias("run_id"), F.col("key").cast("binary").alias("key"), "seqno", F.col("op").cast("int").alias("op"), F.col("value").cast("binary").alias("value"))

    def pack(parts):
        own, nth, held, size = None, 0, [], 0

        def closed():
            content = write_table(held, **options, key=SecretKey(shared.value) if shared else None, table_id=table_id(own, nth))
            arrays = [pa.array([x], pa.int64()) for x in (own, nth, table_id(own, nth))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([content], pa.binary())], ["run_id", "part", "table_id", "content"])

        for batch in parts:
            for of, *record in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and (of != own or size >= file_bytes):
                    yield closed()
                    nth, held, size = (nth + 1 if of == own else 0), [], 0
                own = of
                held.append(tuple(record))
                size += len(record[0]) + len(record[3]) + 16
        if held:
            yield closed()

    return rows.repartition("run_id").sortWithinPartitions("run_id", "key", F.desc("seqno")).mapInArrow(pack, "run_id long, part long, table_id long, content binary")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files, a row each; a damaged file gives those before the damage and one row with ``error``."""
    return records(spark.read.format("binaryFile").load(path).select("path", "content"))


def records(files: DataFrame, key: SecretKey | None = None) -> DataFrame:
    """As ``read_tables`` for rows (path, content), or (path, content, table_id) of sealed files.  One block is decoded at a time."""
    import pyarrow as pa

    shared = _shared(files, key)

    kinds = (pa.string(), pa.binary(), pa.int64(), pa.int8(), pa.binary(), pa.string())

    def packed(rows):
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SCHEMA.names)

    def run(batches):
        for batch in batches:
            rows = []
            for name, content, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    table = Table(content, SecretKey(shared.value) if shared else None, own)
                    for i in range(len(table.index)):
                        rows += [(name, k, s, op, v, None) for k, s, op, v in table.block(i).records()]
                        if len(rows) > 10_000:
                            yield packed(rows)
                            rows = []
                except ValueError as e:
                    rows.append((name, None, None, None, None, str(e)))
            yield packed(rows)

    return files.select("path", "content", "table_id" if key else F.lit(0).alias("table_id")).mapInArrow(run, SCHEMA)


def summaries(files: DataFrame) -> DataFrame:
    """(path, entries, blocks, min_seqno, max_seqno, bytes_written) of the headers of files (path, content); null for a damaged one."""
    import pyarrow as pa

    names = ["path", "entries", "blocks", "min_seqno", "max_seqno", "bytes_written"]

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    t = Table(content)
                    rows.append((name, t.entries, t.blocks, t.min_seqno, t.max_seqno, len(content)))
                except ValueError:
                    rows.append((name, None, None, None, None, len(content)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] + [pa.int64()] * 5)], names)

    return files.select("path", "content").mapInArrow(run, "path string, entries long, blocks long, min_seqno long, max_seqno long, bytes_written long")


def lookups(files: DataFrame, keys: list[bytes], seqno: int) -> DataFrame:
    """(path, key, seqno, op, value): what each file (path, content) has for each of a few keys at a sequence number, by filter, index and block."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = Table(content)
                rows += [(name, key, *found) for key in keys if (found := table.get(key, seqno)) is not None]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "key", "seqno", "op", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, key binary, seqno long, op int, value binary")
