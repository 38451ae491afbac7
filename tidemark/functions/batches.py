"""Write batches: atomic lists of puts and deletes, and their encoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import varint

PUT, DELETE = 0, 1
#: More operations than this are refused, when a batch is written as when it is read.
MAX_OPS = 1 << 20


class FormatError(ValueError):
    """Bytes that aren't what they should be."""


@dataclass
class WriteBatch:
    """Operations that become visible together; of several on one key the last one counts."""

    ops: list[tuple[int, bytes, bytes]] = field(default_factory=list)

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((PUT, key, value))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((DELETE, key, b""))
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def encode(self) -> bytes:
        if len(self.ops) > MAX_OPS:
            raise FormatError(f"a batch holds {MAX_OPS} operations at most")
        out = [varint.encode(len(self.ops), 32)]
        for op, key, value in self.ops:
            out += [bytes([op]), varint.encode(len(key), 32), key]
            if op == PUT:
                out += [varint.encode(len(value), 32), value]
        return b"".join(out)

    @classmethod
    def decode(cls, data: bytes) -> WriteBatch:
        count, at = varint.decode(data, 0, 32)
        if count > MAX_OPS:
            raise FormatError(f"a batch holds {MAX_OPS} operations at most")
        batch = cls()

        def piece(at: int) -> tuple[bytes, int]:
            size, used = varint.decode(data, at, 32)
            end = at + used + size
            if end > len(data):
                raise varint.DecodeError("the bytes end within an operation")
            return data[at + used : end], end

        for _ in range(count):
            if at >= len(data):
                raise varint.DecodeError("the bytes end before an operation")
            op = data[at]
            if op not in (PUT, DELETE):
                raise FormatError(f"unknown operation {op:#04x}")
            key, at = piece(at + 1)
            value, at = piece(at) if op == PUT else (b"", at)
            batch.ops.append((op, key, value))
        if at != len(data):
            raise FormatError(f"{len(data) - at} bytes after the last operation")
        return batch


DECODED = T.StructType(
    [
        T.StructField("batch_pos", T.IntegerType()),
        T.StructField("op", T.ByteType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def decoded(payloads: DataFrame, payload: str = "payload", seqno: str = "seqno", also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each operation of each payload, with the columns ``also``; a payload that can't be read gives one row with ``error``."""
    import pyarrow as pa

    schema = T.StructType([*[payloads.schema[c] for c in also], T.StructField("seqno", T.LongType()), *DECODED.fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for nth, (number, data) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                try:
                    rows += [(nth, number, i, op, key, value, None) for i, (op, key, value) in enumerate(WriteBatch.decode(data).ops)]
                except ValueError as e:
                    rows.append((nth, number, None, None, None, None, str(e)))
            at, *columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.string())
            own = [part.column(2 + i).take(pa.array(at, pa.int64())) for i in range(len(also))]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(columns, kinds)]], schema.names)

    return payloads.select(F.col(seqno).cast("long"), F.col(payload).cast("binary"), *also).mapInArrow(run, schema)


def encoded(log: DataFrame, *also: str) -> DataFrame:
    """(seqno, payload): the batch of each sequence number of a change log, with ``also`` as further columns that it goes by.

    A task has the operations of its batches in order and encodes them as they come; a batch has ``MAX_OPS`` operations at most.
    """
    import pyarrow as pa

    keys = [*also, "seqno"]
    sorted_ops = log.select(*keys, "batch_pos", F.col("op").cast("int"), F.col("key").cast("binary"), F.col("value").cast("binary")).repartition(*keys).sortWithinPartitions(*keys, "batch_pos")
    schema = T.StructType([*[log.schema[c] for c in also], T.StructField("seqno", T.LongType()), T.StructField("payload", T.BinaryType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, batch, size = None, WriteBatch(), 0
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, k.type) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for part in parts:
            kinds = [*[part.schema.field(i) for i in range(len(keys))], pa.field("payload", pa.binary())]
            columns = [part.column(i).to_pylist() for i in range(part.num_columns)]
            for *own, _, op, key, value in zip(*columns):
                if own != held:
                    if held is not None:
                        out.append((*held, batch.encode()))
                        size += len(out[-1][-1])
                        if size > 8 << 20:
                            yield flushed()
                            size = 0
                    held, batch = own, WriteBatch()
                batch.ops.append((op, key, value or b""))
        if held is not None:
            out.append((*held, batch.encode()))
            yield flushed()

    return sorted_ops.mapInArrow(run, schema)
