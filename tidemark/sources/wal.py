"""Write-ahead log segments: 32 KiB blocks of checked fragments."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import FormatError, encoded
from ..functions.checksum import crc32c

#: Fixed values of the format.
MAGIC, VERSION = 0x4C574B50, 1
BLOCK, SEGMENT_HEADER, RECORD_HEADER = 32 * 1024, 32, 16
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


class CorruptionError(ValueError):
    """Fragments in an order that no writer makes."""


@dataclass(frozen=True)
class Outcome:
    """What a read met: ``record``, ``end`` of the segment, or a ``torn`` tail from ``truncate_to`` on."""

    kind: str
    seqno: int | None = None
    payload: bytes | None = None
    truncate_to: int | None = None
    reason: str | None = None


class SegmentWriter:
    """A segment in memory; ``data`` is what is on disk."""

    def __init__(self, segment_id: int, first_seqno: int, rotate_at: int = 64 << 20):
        head = struct.pack("<IIQQ", MAGIC, VERSION, segment_id, first_seqno)
        self.data = bytearray(head + struct.pack("<II", crc32c(head), 0))
        self.segment_id, self.rotate_at = segment_id, rotate_at

    def append(self, seqno: int, payload: bytes) -> int:
        """Where the record starts.  It is cut where blocks end; a header never straddles two."""
        start, at, first = None, 0, True
        while first or at < len(payload):
            room = BLOCK - len(self.data) % BLOCK
            if room < RECORD_HEADER:
                self.data += bytes(room)
                room = BLOCK
            part = payload[at : at + room - RECORD_HEADER]
            last = at + len(part) == len(payload)
            kind = {(True, True): FULL, (True, False): FIRST, (False, False): MIDDLE, (False, True): LAST}[first, last]
            start = len(self.data) if start is None else start
            checked = struct.pack("<BBQ", kind, 0, seqno)
            self.data += struct.pack("<IHBBQ", crc32c(part, crc32c(checked)), len(part), kind, 0, seqno) + part
            at, first = at + len(part), False
        return start

    def should_rotate(self) -> bool:
        return len(self.data) >= self.rotate_at


def read_segment(data: bytes) -> Iterator[Outcome]:
    """The records of a segment, then how it ends.  A bad header of the segment is an error."""
    if len(data) < SEGMENT_HEADER:
        raise FormatError("the segment is shorter than its header")
    magic, version, _, _, crc, reserved = struct.unpack_from("<IIQQII", data)
    if magic != MAGIC:
        raise FormatError("not a segment")
    if version != VERSION:
        raise FormatError(f"unsupported version {version}")
    if crc != crc32c(data[:24]) or reserved:
        raise FormatError("the segment's header is damaged")
    at, held, begun, number = SEGMENT_HEADER, [], None, None
    while True:
        room = BLOCK - at % BLOCK
        if room < RECORD_HEADER:
            at += room
        safe = at if begun is None else begun
        if at >= len(data):
            yield Outcome("end") if begun is None else Outcome("torn", truncate_to=safe, reason="a record is unfinished")
            return
        torn = None
        if at + RECORD_HEADER > len(data):
            torn = "a header is cut"
        else:
            crc, size, kind, reserved, seqno = struct.unpack_from("<IHBBQ", data, at)
            part = data[at + RECORD_HEADER : at + RECORD_HEADER + size]
            if not any(data[at : at + RECORD_HEADER]):
                torn = "zeros"
            elif not FULL <= kind <= LAST:
                torn = f"unknown fragment type {kind}"
            elif len(part) < size:
                torn = "a payload is cut"
            elif crc != crc32c(part, crc32c(struct.pack("<BBQ", kind, reserved, seqno))):
                torn = "a checksum differs"
        if torn:
            yield Outcome("torn", truncate_to=safe, reason=torn)
            return
        if (kind in (FULL, FIRST)) != (begun is None):
            raise CorruptionError("a fragment is out of order")
        if begun is not None and seqno != number:
            raise CorruptionError("fragments of one record differ in their number")
        begun, number = (at if begun is None else begun), seqno
        held.append(part)
        at += RECORD_HEADER + size
        if kind in (FULL, LAST):
            yield Outcome("record", seqno, b"".join(held))
            held, begun = [], None


SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("seqno", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("truncate_to", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)


def segments(log: DataFrame, run: str = "run_id", rotate_at: int = 64 << 20) -> DataFrame:
    """(run_id, segment, content): the batches of each run of a change log as segment files, which rotate at a size."""
    import pyarrow as pa

    payloads = encoded(log.select(F.col(run).cast("long").alias("run_id"), "seqno", "batch_pos", "op", "key", "value"), "run_id")
    schema = "run_id long, segment long, content binary"

    def pack(parts):
        writer, own, nth = None, None, 0

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([nth], pa.int64()), pa.array([bytes(writer.data)], pa.binary())], ["run_id", "segment", "content"])

        for part in parts:
            for of, seqno, payload in zip(*(part.column(i).to_pylist() for i in range(3))):
                if writer is not None and (of != own or writer.should_rotate()):
                    yield closed()
                    nth = nth + 1 if of == own else 0
                    writer = None
                if writer is None:
                    own, writer = of, SegmentWriter(nth, seqno, rotate_at)
                writer.append(seqno, payload)
        if writer is not None:
            yield closed()

    return payloads.repartition("run_id").sortWithinPartitions("run_id", "seqno").mapInArrow(pack, schema)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each outcome of each segment file; damage is a row of its own, not a failed job."""
    return outcomes(spark.read.format("binaryFile").load(path).select("path", "content"))


def outcomes(files: DataFrame) -> DataFrame:
    """As ``read_segments`` for rows (path, content)."""
    import pyarrow as pa

    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())

    def packed(rows):
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SCHEMA.names)

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for o in read_segment(content):
                        rows.append((name, o.kind, o.seqno, o.payload, o.truncate_to, o.reason))
                        size += len(o.payload or b"")
                        if size > 8 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                except ValueError as e:
                    rows.append((name, "invalid", None, None, None, str(e)))
            yield packed(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
