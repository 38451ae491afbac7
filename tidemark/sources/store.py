"""A store: sorted Parquet runs under a manifest, and a log of batches that aren't in a run yet."""

from __future__ import annotations

import json
import re
import secrets
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import MAX_OPS, FormatError, WriteBatch, decoded
from ..functions.crypto import AuthenticationError, SecretKey, key_check, run_key, seal_records, unseal_records
from ..operators import maintain, read
from ..operators.log import LOG_SCHEMA, MAX_SEQNO
from .fs import Files
from .wal import CorruptionError, SegmentWriter, read_segments

_RECENT = T.StructType(LOG_SCHEMA.fields[:-1])
_LOG_NAME = re.compile(r"wal-(\d{8,})\.log")
_RUN_NAME = re.compile(r"(\d{8,})-[0-9a-f]{12}")


def log_name(seqno: int) -> str:
    return f"wal-{seqno:08d}.log"


def parse_log_name(name: str) -> int | None:
    found = _LOG_NAME.fullmatch(name)
    return int(found[1]) if found else None


def parse_run_name(name: str) -> int | None:
    found = _RUN_NAME.fullmatch(name)
    return int(found[1]) if found else None


@dataclass(frozen=True)
class Config:
    """``bits_per_key`` sizes the Bloom filters of the runs; 0 leaves them out.

    ``partition_bytes`` and ``partition_rows`` bound what one task of a run's writing sorts, seals and writes, but for the skew of the ranges.
    """

    memtable_bytes: int = 4 << 20
    bits_per_key: int = 10
    partition_bytes: int = 128 << 20
    encryption: SecretKey | None = None
    max_key_bytes: int = 1 << 30
    max_value_bytes: int = 1 << 30
    partition_rows: int = 1 << 18


@dataclass(frozen=True)
class Manifest:
    """A version of the store: its runs, newest first, and the newest sequence number in them."""

    version: int
    seqno: int
    next_run: int
    runs: tuple[dict, ...]
    encrypted: bool
    #: The last micro-batch of a stream that is in the runs.
    stream_batch: int = -1
    #: Random text, and a digest of it under the key: tells a wrong key from the right one.
    salt: str = ""
    check: str = ""

    def to_json(self) -> bytes:
        return json.dumps({**asdict(self), "runs": list(self.runs)}).encode()

    @classmethod
    def from_json(cls, data: bytes) -> Manifest:
        x = json.loads(data)
        return cls(**{**x, "runs": tuple(x["runs"])})


class Store:
    """One writer, any number of readers.

    A batch is durable once its log segment is published, and visible from then on; ``flush`` moves what is logged into a run
    and ``compact`` merges the runs.  Each publishes a new manifest by a rename; a reader keeps the one that it opened.
    Records are told apart by their numbers alone, so that a log that is replayed after its run was
    published changes nothing.

    A store that is opened with another key than its own is refused before anything is read, and a value that fails its
    authentication fails the read.  So does damage in the log: segments are published whole, so that every damaged
    one was acknowledged; opening the store raises and leaves it as it is, and ``log_damage`` tells what is wrong.
    Values are sealed in runs; keys, and the log until it is flushed, are plain text.

    The first write makes an instance the writer, by a marker that only one can create; an older writer's next write fails, and
    so does the first write of one that opened the store before the present writer did.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.config, self.files = spark, config, Files(spark, path)
        self._writer, self._seen = None, self._writers()
        versions = [int(n[:-5]) for n in self.files.list("manifest") if n.endswith(".json")]
        key = config.encryption
        if versions:
            self.manifest = Manifest.from_json(self.files.read(f"manifest/{max(versions):010d}.json"))
        else:
            salt = secrets.token_hex(16) if key else ""
            self.manifest = Manifest(0, 0, 1, (), key is not None, salt=salt, check=key_check(key, salt) if key else "")
            self._publish(self.manifest)
        if self.manifest.encrypted != (key is not None):
            raise FormatError("the store is encrypted, and no key is given" if self.manifest.encrypted else "the store is not encrypted, and a key is given")
        if key and key_check(key, self.manifest.salt) != self.manifest.check:
            raise AuthenticationError("the key is not that of the store")
        self.logged = self._log_numbers()
        self._seqno = max([self.manifest.seqno, *self.logged])
        self._recent = self._replayed()
        self._bytes = sum(len(k) + len(v) for k, _, _, v, _ in self._recent)

    def _log_numbers(self) -> list[int]:
        return sorted(n for x in self.files.list("wal") if (n := parse_log_name(x)) is not None and n > self.manifest.seqno)

    def _outcomes(self) -> DataFrame:
        """(seqno of the segment's name, outcome, seqno, payload, reason) of what is logged."""
        rows = read_segments(self.spark, [self.files.path(f"wal/{log_name(n)}") for n in self.logged])
        return rows.withColumn("named", F.regexp_extract("path", r"wal-(\d+)\.log$", 1).cast("long"))

    def _replayed(self) -> list[tuple]:
        """The logged operations, which ``memtable_bytes`` bound but for the last batch; damage raises."""
        if not self.logged:
            return []
        outcomes = self._outcomes().select("named", "outcome", "seqno", "payload", "reason").collect()
        records, ended = {}, set()
        for r in outcomes:
            if r["outcome"] == "end":
                ended.add(r["named"])
            elif r["outcome"] == "record" and r["seqno"] == r["named"]:
                records[r["named"]] = bytes(r["payload"])
            else:
                raise CorruptionError(f"{log_name(r['named'])}: {r['reason'] or 'a record of another segment'}")
        for n in self.logged:
            if n not in ended or n not in records:
                raise CorruptionError(f"{log_name(n)}: the batch is missing")
        found = []
        for n in self.logged:
            try:
                found += self._rows(n, WriteBatch.decode(records[n]))
            except ValueError as e:
                raise CorruptionError(f"{log_name(n)}: {e}") from e
        return found

    @staticmethod
    def _rows(seqno: int, batch: WriteBatch) -> list[tuple]:
        return [(bytes(key), seqno, op, bytes(value), i) for i, (op, key, value) in enumerate(batch.ops)]

    @classmethod
    def log_damage(cls, spark: SparkSession, path: str) -> DataFrame:
        """(path, outcome, truncate_to, reason) of the log segments that can't be read, without opening the store."""
        files = Files(spark, path)
        names = [n for n in files.list("wal") if parse_log_name(n) is not None]
        schema = "path string, outcome string, truncate_to long, reason string"
        if not names:
            return spark.createDataFrame([], schema)
        rows = read_segments(spark, [files.path(f"wal/{n}") for n in names]).withColumn("name", F.regexp_extract("path", r"[^/]+$", 0))
        bad = rows.where("outcome not in ('record', 'end')").select("name", "outcome", "truncate_to", "reason")
        broken = decoded(rows.where("outcome = 'record'")).where("error is not null")
        broken = broken.select(F.format_string("wal-%08d.log", "seqno"), F.lit("record"), F.lit(None).cast("long"), "error")
        listed = spark.createDataFrame([(n,) for n in names], "name string")
        empty = listed.join(rows.where("outcome = 'record'"), "name", "left_anti").join(bad, "name", "left_anti")
        return bad.union(broken).union(empty.select("name", F.lit("empty"), F.lit(None).cast("long"), F.lit("the batch is missing"))).toDF("path", "outcome", "truncate_to", "reason")

    def _publish(self, manifest: Manifest) -> None:
        self.files.publish(f"manifest/{manifest.version:010d}.json", manifest.to_json())
        self.manifest = manifest

    def _writers(self) -> int:
        return max([int(n) for n in self.files.list("writers") if n.isdigit()], default=0)

    def _claim(self) -> None:
        """Makes this the store's writer, or checks that it still is."""
        newest = self._writers()
        if newest != (self._seen if self._writer is None else self._writer):
            raise FileExistsError("the store has another writer")
        if self._writer is None:
            self.files.create(f"writers/{newest + 1:010d}", b"")
            self._writer = newest + 1

    def _advance(self) -> int:
        if self._seqno >= MAX_SEQNO:
            raise OverflowError("sequence numbers end at 2**63 - 1")
        self._seqno += 1
        return self._seqno

    # writes

    def put(self, key: bytes, value: bytes) -> int:
        return self.write(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> int:
        return self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch) -> int:
        """Commits a batch under one number, which is returned; an empty one takes a number too."""
        if len(batch) > MAX_OPS:
            raise FormatError(f"a batch holds {MAX_OPS} operations at most")
        for _, key, value in batch.ops:
            if len(key) > self.config.max_key_bytes or len(value) > self.config.max_value_bytes:
                raise FormatError(f"a key has {self.config.max_key_bytes} bytes at most, a value {self.config.max_value_bytes}")
        payload = batch.encode()
        self._claim()
        seqno = self._advance()
        segment = SegmentWriter(seqno, seqno)
        segment.append(seqno, payload)
        self.files.publish(f"wal/{log_name(seqno)}", bytes(segment.data))
        self.logged.append(seqno)
        self._recent += self._rows(seqno, batch)
        self._bytes += len(payload)
        if self._bytes >= self.config.memtable_bytes:
            self.flush()
        return seqno

    def append(self, ops: DataFrame, stream_batch: int | None = None) -> int:
        """Commits (key, op, value), with batch_pos if keys repeat, of any size under one number, straight into a run.

        A ``stream_batch`` that is in the store by its manifest changes nothing.
        """
        if stream_batch is not None and stream_batch <= self.manifest.stream_batch:
            return self._seqno
        self._claim()
        self.flush()
        seqno = self._advance()
        pos = F.col("batch_pos") if "batch_pos" in ops.columns else F.lit(0)
        rows = ops.select(F.col("key").cast("binary").alias("key"), F.lit(seqno).cast("long").alias("seqno"), F.col("op").cast("tinyint").alias("op"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), pos.cast("int").alias("batch_pos"))
        self._add_run(rows, seqno, stream_batch)
        return seqno

    # runs

    def _write_run(self, rows: DataFrame, number: int, sealed: tuple[dict, ...] = ()) -> dict:
        """Writes rows sorted by key, newest first, in key ranges; what the manifest says of them.

        Values of ``sealed`` runs come as they are stored, with their run_id: rows are counted, sampled, moved and sorted sealed, and each is
        opened once, where it is sealed again.  Ranges are those of the whole order, so that a frequent key is in several.
        Each attempt has a folder and a key of its own, so that what a crash leaves behind is in nobody's way; ``vacuum`` deletes it.
        """
        folder = f"{number:08d}-{uuid.uuid4().hex[:12]}"
        path = self.files.path(f"runs/{folder}")
        bits = self.config.bits_per_key
        size = rows.agg(F.count("*"), F.sum(F.octet_length("key") + F.octet_length("value") + 24)).first()
        parts = max(1, -(-(size[1] or 0) // self.config.partition_bytes), -(-size[0] // self.config.partition_rows))
        sort = ["key", F.desc("seqno"), F.desc("batch_pos")]
        # one range is a shuffle too: what the rows come from stays in many tasks
        ranged = rows.repartitionByRange(parts, *sort) if parts > 1 else rows.repartition(1)
        ranged = ranged.sortWithinPartitions(*sort)
        if sealed:
            ranged = self._opened(ranged, *sealed)
        ranged = ranged.drop("run_id")
        if self.config.encryption:
            ranged = seal_records(ranged, self._run_key(folder), number)
        # a filter of so many bits a key has this share of false positives
        share = min(0.99, 0.6185 ** max(1, bits))
        writer = ranged.write.option("parquet.bloom.filter.enabled#key", str(bits > 0).lower()).option("parquet.bloom.filter.fpp#key", str(share))
        writer.option("parquet.bloom.filter.expected.ndv#key", str(max(1, size[0] // parts))).parquet(path)
        found = self.spark.read.parquet(path).agg(F.count("*"), F.hex(F.min("key")), F.hex(F.max("key")), F.min("seqno"), F.max("seqno")).first()
        return {"run_id": number, "folder": folder, "records": found[0], "min_key": found[1], "max_key": found[2], "min_seqno": found[3], "max_seqno": found[4], "encrypted": bool(self.config.encryption)}

    def _run_key(self, folder: str) -> SecretKey:
        return run_key(self.config.encryption, parse_run_name(folder), f"tidemark:run:v2:{folder}:".encode())

    def _add_run(self, rows: DataFrame, seqno: int, stream_batch: int | None = None) -> None:
        number = self.manifest.next_run
        run = self._write_run(rows, number)
        runs = (run, *self.manifest.runs) if run["records"] else self.manifest.runs
        self._publish(replace(self.manifest, version=self.manifest.version + 1, seqno=seqno, next_run=number + 1, runs=runs, stream_batch=self.manifest.stream_batch if stream_batch is None else stream_batch))

    def _logged_rows(self) -> DataFrame:
        """The operations of the logged batches; empty where there are none."""
        return self.spark.createDataFrame(self._recent, _RECENT)

    def flush(self) -> None:
        """Moves the logged batches into a run; nothing to do without any."""
        if not self.logged:
            return
        self._claim()
        self._add_run(self._logged_rows(), self._seqno)
        for n in self.logged:
            self.files.remove(f"wal/{log_name(n)}")
        self.logged, self._recent, self._bytes = [], [], 0

    close = flush

    def compact(self, floor: int | None = None) -> int:
        """Merges all runs into one and returns its number of records; nothing to do with fewer than two runs.

        Every version is kept unless a ``floor`` is given, below which no snapshot will be read.
        """
        if len(self.manifest.runs) < 2:
            return 0
        self._claim()
        old = self.manifest.runs
        sealed = tuple(r for r in old if r["encrypted"])
        rows = maintain.compacted([self._stored(r) for r in old])
        if floor is not None:
            if sealed:
                # what pruning drops has to be authentic too
                self._opened(rows, *sealed).agg(F.sum(F.octet_length("value"))).first()
            rows = maintain.pruned(rows, floor)
        number = self.manifest.next_run
        run = self._write_run(rows, number, sealed)
        self._publish(replace(self.manifest, version=self.manifest.version + 1, next_run=number + 1, runs=(run,)))
        return run["records"]

    def vacuum(self) -> None:
        """Deletes runs and manifests that the current manifest doesn't name; readers of older ones then fail."""
        self._claim()
        named = {r["folder"] for r in self.manifest.runs}
        for name in self.files.list("runs"):
            if name not in named:
                self.files.remove(f"runs/{name}")
        for name in self.files.list("manifest"):
            if name != f"{self.manifest.version:010d}.json":
                self.files.remove(f"manifest/{name}")

    # reads

    def _stored(self, run: dict) -> DataFrame:
        """A run as it is stored: values of an encrypted one are sealed."""
        return self.spark.read.parquet(self.files.path(f"runs/{run['folder']}")).withColumn("run_id", F.lit(run["run_id"]).cast("long"))

    def _opened(self, rows: DataFrame, *runs: dict) -> DataFrame:
        """Stored rows of encrypted runs with their values decrypted."""
        return unseal_records(rows, {r["run_id"]: self._run_key(r["folder"]) for r in runs})

    def _run(self, run: dict) -> DataFrame:
        rows = self._stored(run)
        return self._opened(rows, run) if run["encrypted"] else rows

    def log(self, keys: tuple[bytes | None, bytes | None] = (None, None), seqno: int | None = None) -> DataFrame:
        """The change log; runs that can't hold a key of the range, or a version at the snapshot, are left out."""
        lo, hi = keys
        names = LOG_SCHEMA.names
        out = self._logged_rows().withColumn("run_id", F.lit(self.manifest.next_run).cast("long")).select(*names)
        for run in self.manifest.runs:
            out_of_range = (lo is not None and bytes.fromhex(run["max_key"]) < lo) or (hi is not None and bytes.fromhex(run["min_key"]) > hi)
            if not out_of_range and (seqno is None or run["min_seqno"] <= seqno):
                out = out.unionByName(self._run(run).select(*names))
        return out

    def snapshot(self) -> int:
        return self._seqno

    def get(self, key: bytes, seqno: int | None = None) -> bytes | None:
        if len(key) > self.config.max_key_bytes:
            raise FormatError(f"a key has {self.config.max_key_bytes} bytes at most")
        rows = read.get(self.log((key, key), seqno), key, seqno).take(1)
        return bytes(rows[0]["value"]) if rows else None

    def multi_get(self, keys: Iterable[bytes], seqno: int | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(k,) for k in keys], "key binary")
        return read.multi_get(self.log(seqno=seqno), asked, seqno)

    def range_bounds(self, start: read.Bound = read.UNBOUNDED, end: read.Bound = read.UNBOUNDED, seqno: int | None = None) -> DataFrame:
        return read.range_bounds(self.log((start.key, end.key), seqno), start, end, seqno)

    def range(self, start: bytes, end: bytes) -> DataFrame:
        return self.range_bounds(read.included(start), read.excluded(end))

    def scan_page(self, start: str | None = None, end: str | None = None, limit: int = 1000) -> DataFrame:
        """One row, ``records`` and ``truncated``, for base64 bounds: the start is included, the end is not.  Bad base64 is an error."""
        bounds = read.from_base64(start, end)
        return read.response(self.log((bounds[0].key, bounds[1].key)), *bounds, limit)

    def scan_all(self, seqno: int | None = None) -> DataFrame:
        return self.range_bounds(seqno=seqno)

    def statistics(self) -> dict:
        return {"run_count": len(self.manifest.runs), "current_seqno": self._seqno, "encrypted": self.manifest.encrypted}

    def run_metadata(self) -> DataFrame:
        fields = "run_id long, records long, min_key string, max_key string, min_seqno long, max_seqno long, encrypted boolean"
        return self.spark.createDataFrame([tuple(r[c.split()[0]] for c in fields.split(", ")) for r in self.manifest.runs], fields)
