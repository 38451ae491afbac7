"""What several operators share: word hashing on Arrow buffers, components, storage.

Words are maximal runs of bytes outside ``0x20`` and ``0x09``-``0x0D``.  A word is
hashed on its UTF-8 bytes, a whole block of documents at a time in NumPy, so
no Python string is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are hashed at a time; bounds the temporary arrays.
BLOCK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 2)
        base = 0xD6E8FEB86659FD93
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of a block of documents; ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int, sep: bytes = b" ") -> bytes:
        """Words i to j - 1, joined."""
        data = self.data
        return sep.join([data[a:b].tobytes() for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist())])

    def windows(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each n consecutive words of one document, and where they start."""
        total = len(self.hash) - n + 1
        if total <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key = np.zeros(total, np.uint64)
        weight = 0xA24BAED4963EE407 + 2 * salt
        for k in range(n):
            key += self.hash[k : k + total] * np.uint64(weight)
            weight = weight * 0x9FB21C651E98DF25 % (1 << 64) | 1
        at = np.flatnonzero(self.doc[:total] == self.doc[n - 1 :])
        return mix64(key[at]), at


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string column."""
    valid = np.asarray(column.is_valid())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets, valid


def word_blocks(column: pa.Array, lower: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[Words]:
    """The words of a string column, in blocks of whole documents.  A null has no words."""
    data, offsets, valid = text_buffers(column)
    n, lo = len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1)
        hi = min(hi, n)
        yield _hash_block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], valid[lo:hi], np.arange(lo, hi), lower)
        lo = hi


def _hash_block(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray, rows: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    size = len(data)
    inside = ~_SEPARATOR[data]
    for d in np.flatnonzero(~valid):
        inside[offsets[d] : offsets[d + 1]] = False
    starts, ends = inside.copy(), inside.copy()
    if size:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < size)]
        starts[edge] |= inside[edge]
        ends[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _power_tables(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:size], out=total[1:])
    key = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, rows, start, end, key, doc, first)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's BIGINT."""
    return np.ascontiguousarray(x).view(np.int64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one where none is set, in local mode only."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tidemark-"))
    return configured or context.getCheckpointDir()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs in the block as soon as it has run."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def give_back() -> None:
    """Returns the memory of this process that is free to the system, as far as it can be."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; when it ends its worker, which waits for the next task, gives the memory that is free back."""

    def relieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return relieved


_thread = threading.local()


def _scopes() -> list[list[DataFrame]]:
    """The blocks of this thread that delete what is saved in them, the innermost last."""
    if not hasattr(_thread, "scopes"):
        _thread.scopes = []
    return _thread.scopes


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; lineage is cut, and the shuffles that led to them are deleted."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        # a plan goes by the setting at the time when it is made
        kept = df.select("*").checkpoint()
    if _scopes():
        _scopes()[-1].append(kept)
    return kept


def discard(df: DataFrame) -> None:
    """Deletes the files of saved rows that nothing needs any more."""
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if found.isDefined():
        removed(df.sparkSession, found.get())


@contextlib.contextmanager
def temporaries() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is saved in the block is deleted when it ends, but for rows that are handed to ``keep``, which are the enclosing block's, if there is one."""
    own: list[DataFrame] = []
    _scopes().append(own)

    def keep(df: DataFrame) -> DataFrame:
        at = next(i for i, x in enumerate(own) if x is df)
        own.pop(at)
        place = next(i for i, x in enumerate(_scopes()) if x is own)
        if place:
            _scopes()[place - 1].append(df)
        return df

    try:
        yield keep
    finally:
        place = next(i for i, x in enumerate(_scopes()) if x is own)
        del _scopes()[place]
        for df in own:
            discard(df)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """The rows of df as a Parquet table in the shared folder, deleted when the block ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        removed(spark, path)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node.

    Alternates large-star and small-star steps, which converge in a number of
    rounds logarithmic in the size of a component.  Minima are taken with partial
    aggregation and joined back, so that a node with very many edges is never
    gathered in a task.  Null ends are dropped, loops are harmless.
    """
    with temporaries() as keep:
        pairs = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
        pairs = saved(pairs.where("v is not null and u is not null and v <> u").distinct())
        state = None
        for _ in range(rounds):
            both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
            before, pairs = pairs, saved(small.where("u <> v").distinct())
            discard(before)
            now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
        return keep(saved(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()))


def running_offsets(df: DataFrame, group: list[str], key: str, order: list[str], add: str, rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds ``before``: the sum of ``add`` over the earlier rows of the same group.

    ``key`` is a hex digest that spreads rows evenly and leads the order.  Each
    group is cut into equal ranges of the digest; a window runs within a range
    and starts at the sum of the group's earlier ranges.  A group of any size is so
    spread over many tasks, and the ranges are fixed, so that reruns agree.
    """
    from pyspark.sql import Window

    n = df.count()
    buckets = 1
    while buckets * rows_per_bucket < n and buckets < 1 << 20:
        buckets *= 2
    ranged = df.withColumn("_range", F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)))
    sums = ranged.groupBy(*group, "_range").agg(F.sum(add).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_within", F.coalesce(F.sum(add).over(within), F.lit(0)))
    on = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    drop = ["_range", "_r", "_within", "_offset", *[f"_g{i}" for i in range(len(group))]]
    return ranged.join(offsets, on).withColumn("before", (F.col("_within") + F.col("_offset")).cast("bigint")).drop(*drop)
