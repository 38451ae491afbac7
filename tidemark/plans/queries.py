"""The registered queries of the change-log engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches, bloom, varint
from ..functions.checksum import crc32c_of, xxh3_of
from ..functions.crypto import AuthenticationError, SecretKey, run_key, seal, unseal
from ..operators import maintain, read
from ..operators.log import batched, events_log
from ..sources import sstable, wal
from ..sources.fs import checkpointed, scratch
from ..sources.store import Config, Store
from ..streaming.ingest import ingest

LOW, HIGH, PREFIX, ONE_KEY = "user-0000000020", "user-0000000061", "user-000000001", "user-0000000007"
SNAPSHOT = 4000

#: The events as a change log, as in ``events_log``.
LOG = """log as (
  select format('user-{:010d}', user_id) k, event_id + 1 seqno, (event_type = 'error')::int op,
         case when event_type = 'error' then '' else props end v, event_id // 1250 run from events)"""


def _visible(where: str = "true", name: str = "vis") -> str:
    return f"""{name} as (select k, v, seqno from (
  select *, row_number() over (partition by k order by seqno desc) n from log where {where}) where n = 1 and op = 0)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("key").alias("k"), F.col("value").alias("v"), "seqno", *more)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis")
def scan_all(spark, sf_dir):
    return _out(read.scan_all(_log(spark, sf_dir)))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis")
def latest_max_by(spark, sf_dir):
    newest = read.newest_by_max(_log(spark, sf_dir))
    return _out(newest.where("op = 0"))


@_query(f"with {LOG}, {_visible(f'seqno <= {SNAPSHOT}')} select k, v, seqno from vis")
def scan_at_snapshot(spark, sf_dir):
    return _out(read.scan_all(_log(spark, sf_dir), SNAPSHOT))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis where k >= '{LOW}' and k < '{HIGH}'")
def range_half_open(spark, sf_dir):
    return _out(read.key_range(_log(spark, sf_dir), LOW, HIGH))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis where k >= '{LOW}' and k <= '{HIGH}'")
def range_bounds_incl_incl(spark, sf_dir):
    return _out(read.range_bounds(_log(spark, sf_dir), read.included(LOW), read.included(HIGH)))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis where k > '{LOW}' and k < '{HIGH}'")
def range_bounds_excl_excl(spark, sf_dir):
    return _out(read.range_bounds(_log(spark, sf_dir), read.excluded(LOW), read.excluded(HIGH)))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis where k > '{LOW}' and k <= '{HIGH}'")
def range_bounds_excl_incl(spark, sf_dir):
    return _out(read.range_bounds(_log(spark, sf_dir), read.excluded(LOW), read.included(HIGH)))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis where k < '{HIGH}'")
def range_bounds_unbounded_lo(spark, sf_dir):
    return _out(read.range_bounds(_log(spark, sf_dir), read.UNBOUNDED, read.excluded(HIGH)))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis where k >= '{LOW}'")
def range_bounds_unbounded_hi(spark, sf_dir):
    return _out(read.range_bounds(_log(spark, sf_dir), read.included(LOW)))


@_query(f"with {LOG}, {_visible(f'seqno <= {SNAPSHOT}')} select k, v, seqno from vis where k >= '{LOW}' and k < '{HIGH}'")
def range_at_snapshot(spark, sf_dir):
    return _out(read.range_bounds(_log(spark, sf_dir), read.included(LOW), read.excluded(HIGH), SNAPSHOT))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis where starts_with(k, '{PREFIX}')")
def prefix_scan(spark, sf_dir):
    return _out(read.prefix_scan(_log(spark, sf_dir), PREFIX))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis order by k limit 10")
def scan_limit(spark, sf_dir):
    return _out(read.page(_log(spark, sf_dir), limit=10).drop("truncated"))


@_query(f"with {LOG}, {_visible()} select 10::bigint page_size, count(*) > 10 truncated from vis")
def scan_truncated_flag(spark, sf_dir):
    page = read.page(_log(spark, sf_dir), limit=10)
    return page.agg(F.lit(10).cast("long").alias("page_size"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))


@_query(f"with {LOG}, {_visible()} select base64(k::blob) k, base64(v::blob) v, seqno from vis")
def b64_scan_page(spark, sf_dir):
    rows = read.scan_all(_log(spark, sf_dir))
    return rows.select(F.base64(F.col("key").cast("binary")).alias("k"), F.base64(F.col("value").cast("binary")).alias("v"), "seqno")


@_query(f"with {LOG} select k, v, seqno, op::int op from log where k = '{ONE_KEY}'")
def key_history(spark, sf_dir):
    return _out(read.history(_log(spark, sf_dir), ONE_KEY), "op").withColumn("op", F.col("op").cast("int"))


@_query(f"with {LOG}, {_visible()} select k, v, seqno from vis where k = '{ONE_KEY}'")
def get_key(spark, sf_dir):
    return _out(read.get(_log(spark, sf_dir), ONE_KEY))


@_query(f"with {LOG}, {_visible(f'seqno <= {SNAPSHOT}')} select k, v, seqno from vis where k = '{ONE_KEY}'")
def get_at_snapshot(spark, sf_dir):
    return _out(read.get(_log(spark, sf_dir), ONE_KEY, SNAPSHOT))


_ASKED = "asked as (select distinct format('user-{:010d}', c_custkey % 400) k from customer)"


@_query(f"with {LOG}, {_visible()}, {_ASKED} select asked.k, v, seqno from asked left join vis using (k)")
def multi_get(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("user-%010d", F.col("c_custkey") % 400).alias("key")).distinct()
    return _out(read.multi_get(_log(spark, sf_dir), keys))


@_query(f"with {LOG} select coalesce(max(seqno), 0)::bigint seqno from log")
def snapshot(spark, sf_dir):
    return _log(spark, sf_dir).agg(F.coalesce(F.max("seqno"), F.lit(0)).alias("seqno"))


@_query(f"with {LOG} select k, v, seqno, op::int op, run, row_number() over (order by k, seqno desc)::int place from log")
def merge_runs_ordered(spark, sf_dir):
    """All records in the order of a merge; places are found by range partitions and their sizes, not in one task."""
    out = read.numbered(read.merged([_log(spark, sf_dir)]))
    return _out(out, F.col("op").cast("int").alias("op"), F.col("run_id").alias("run"), F.col("place").cast("int").alias("place"))


@_query(
    f"with {LOG}, b as (select k, v, op, (seqno - 1) // 50 + 1 seqno, (seqno - 1) % 50 pos from log), "
    "r as (select *, row_number() over (partition by k order by seqno desc, pos desc) n from b) select k, v, seqno from r where n = 1 and op = 0"
)
def batch_last_op_wins(spark, sf_dir):
    return _out(read.visible(batched(_log(spark, sf_dir), 50)))


@_query(f"with {LOG} select case when op = 0 then 'put' else 'tombstone' end kind, count(*)::bigint records, count(distinct k)::bigint keys from log group by 1")
def live_vs_tombstone_counts(spark, sf_dir):
    return maintain.live_counts(_log(spark, sf_dir))


@_query(f"with {LOG} select count(distinct run)::bigint run_count, coalesce(max(seqno), 0)::bigint current_seqno from log")
def stats(spark, sf_dir):
    return maintain.statistics(_log(spark, sf_dir))


@_query(f"with {LOG} select run run_id, count(*)::bigint records, min(k) min_key, max(k) max_key, min(seqno) min_seqno, max(seqno) max_seqno from log group by run")
def run_metadata(spark, sf_dir):
    return maintain.run_metadata(_log(spark, sf_dir))


@_query(f"with {LOG} select k, v, seqno, op::int op from log where run % 2 = 0 union all select k, v, seqno, op::int op from log where run % 2 = 1")
def compaction_keep_all(spark, sf_dir):
    log = _log(spark, sf_dir)
    rows = maintain.compacted([log.where("run_id % 2 = 0"), log.where("run_id % 2 = 1")])
    return _out(rows, F.col("op").cast("int").alias("op"))


_NEXT = "nx as (select *, lead(seqno) over (partition by k order by seqno) until_seqno from log)"


@_query(f"with {LOG}, {_NEXT} select k, v, seqno, op::int op from nx where (until_seqno is null or until_seqno > 5000) and not (op = 1 and seqno <= 5000)")
def compaction_pruned(spark, sf_dir):
    return _out(maintain.pruned(_log(spark, sf_dir), 5000), F.col("op").cast("int").alias("op"))


@_query(f"with {LOG}, {_NEXT} select k, seqno, op::int op, until_seqno from nx")
def version_visibility_interval(spark, sf_dir):
    rows = maintain.with_intervals(_log(spark, sf_dir))
    return rows.select(F.col("key").alias("k"), "seqno", F.col("op").cast("int").alias("op"), F.col("until").alias("until_seqno"))


@_query(
    f"with {LOG}, r as (select *, (row_number() over (partition by run order by k, seqno desc) - 1) // 250 block from log) "
    "select run run_id, block, count(*)::bigint records, max(k) last_key from r group by 1, 2"
)
def block_index(spark, sf_dir):
    return maintain.block_index(_log(spark, sf_dir), 250)


@_query(
    f"with {LOG}, r as (select run, k, lag(k) over w before, (row_number() over w - 1) % 16 nth from log window w as (partition by run order by k, seqno desc)), "
    "s as (select run, k, case when nth = 0 or before is null then 0 else "
    "(select count(*) from range(1, 33) t(i) where i <= least(length(k), length(before)) and k[:i] = before[:i]) end shared from r) "
    "select run run_id, count(*)::bigint records, sum(strlen(k))::bigint key_bytes, sum(strlen(k) - shared)::bigint stored_bytes from s group by 1"
)
def prefix_compression_stats(spark, sf_dir):
    return maintain.prefix_compression(_log(spark, sf_dir)).withColumn("stored_bytes", F.col("stored_bytes").cast("long")).withColumn("key_bytes", F.col("key_bytes").cast("long"))


@_query("select o_orderkey, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::int n_bytes from orders")
def varint_len(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", varint.length(F.col("o_orderkey")).alias("n_bytes"))


@_query(
    "select o_orderkey, case when o_orderkey < 128 then printf('%02X', o_orderkey) "
    "when o_orderkey < 16384 then printf('%02X%02X', o_orderkey % 128 + 128, o_orderkey // 128) "
    "when o_orderkey < 2097152 then printf('%02X%02X%02X', o_orderkey % 128 + 128, o_orderkey // 128 % 128 + 128, o_orderkey // 16384) "
    "else printf('%02X%02X%02X%02X', o_orderkey % 128 + 128, o_orderkey // 128 % 128 + 128, o_orderkey // 16384 % 128 + 128, o_orderkey // 2097152) end encoded from orders"
)
def varint_encode(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", F.hex(varint.encoded(F.col("o_orderkey"))).alias("encoded"))


#: The checksum's table and steps in SQL; the events' values are ASCII, so that a character is a byte.
_CRC32C = """t as (select list_transform(range(0, 256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 2197175160::bigint) else c >> 1 end)) entries),
  b as (select seqno, list_concat([4294967295::bigint], list_transform(range(1, length(v) + 1), lambda i: unicode(v[i])::bigint)) octets from log)"""


@_query(f"with {LOG}, {_CRC32C} select seqno, xor(list_reduce(octets, lambda c, o: xor(entries[(xor(c, o) & 255) + 1], c >> 8)), 4294967295::bigint)::bigint checksum from b, t")
def crc32c_values(spark, sf_dir):
    return _log(spark, sf_dir).select("seqno", crc32c_of(F.col("value").cast("binary")).alias("checksum"))


@_query(None)
def xxh3_values(spark, sf_dir):
    return _log(spark, sf_dir).select("seqno", xxh3_of(F.col("value").cast("binary")).alias("checksum"))


@_query(f"""with {LOG}, keys as (select distinct k from log),
  n as (select count(*) n from keys)
  select k, true maybe, greatest(1, ceil(n * 10 / 512.0))::bigint blocks, true own_bits from keys, n""")
def bloom_contains(spark, sf_dir):
    """Every key of the log is found again in its filter, without false negatives; a filter of the same size without bits finds none.

    ``own_bits`` is whether the key's bits, and no more than eight for each key, are in the words.
    """
    keys = checkpointed(_log(spark, sf_dir).select(F.col("key").cast("binary").alias("key")).distinct())
    n = keys.count()
    blocks = bloom.block_count(n)
    words = checkpointed(bloom.build(keys, "key", blocks))
    bits = words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]
    empty = bloom.probe(keys, "key", words.where(F.lit(False)), blocks).where("maybe").count()
    out = bloom.probe(keys, "key", words, blocks)
    return out.select(F.col("key").cast("string").alias("k"), "maybe", F.lit(blocks).cast("long").alias("blocks"), F.lit(empty == 0 and n < bits <= 8 * n).alias("own_bits"))


@_query(None)
def bloom_prune(spark, sf_dir):
    """Of keys that aren't in the log, how many the filter excludes."""
    keys = _log(spark, sf_dir).select(F.col("key").cast("binary").alias("key")).distinct()
    blocks = bloom.block_count(keys.count())
    absent = spark.range(10_000).select(F.format_string("miss-%010d", "id").cast("binary").alias("key"))
    found = bloom.probe(absent, "key", bloom.build(keys, "key", blocks), blocks)
    return found.agg(F.count("*").alias("probed"), F.count(F.when(~F.col("maybe"), 1)).alias("pruned"))


@_query(f"with {LOG} select seqno, k, v, (strlen(v) + 28)::bigint sealed_bytes, true hidden, true bound from log")
def encrypt_round_trip(spark, sf_dir):
    """Values sealed and opened again; their sealed length, whether they are hidden, and whether another run's key, or place, opens nothing."""
    key = run_key(SecretKey(bytes(range(32))), 7)
    rows = _log(spark, sf_dir).select("seqno", "key", F.col("value").cast("binary").alias("value"))
    sealed = seal(rows.withColumn("before", F.col("value")), "value", key, 7, "seqno").withColumn("sealed", F.col("value"))
    plain = unseal(sealed, "value", key, 7, "seqno").withColumn("opened", F.col("value"))
    other = plain.withColumn("value", F.col("sealed"))
    other = unseal(other, "value", run_key(SecretKey(bytes(range(32))), 8), 7, "seqno").withColumn("by_key", F.col("value"))
    other = unseal(other.withColumn("value", F.col("sealed")), "value", key, 8, "seqno").withColumn("by_place", F.col("value"))
    hidden = F.instr(F.hex("sealed"), F.hex("before")) == 0
    return other.select(
        "seqno", F.col("key").alias("k"), F.col("opened").cast("string").alias("v"), F.octet_length("sealed").cast("long").alias("sealed_bytes"),
        (hidden | (F.octet_length("before") == 0)).alias("hidden"), (F.col("by_key").isNull() & F.col("by_place").isNull()).alias("bound"),
    )


# stores, log segments and table files, built from the events in the shared folder

#: What a store holds after three bulk appends, one batch, a put and a delete; ``pos`` is the place in the batch.
STORED = f"""{LOG}, stored as (
  select k, v, op, ((seqno - 1) % 3 + 1)::bigint seqno, ((seqno - 1) // 3)::int pos from log
  union all select * from (values ('user-0000000002', 'batch', 0, 4, 0), ('user-0000000005', '', 1, 4, 1), ('zz-new', '1', 0, 4, 2),
    ('zz-new', '2', 0, 4, 3), ('user-0000000002', 'put', 0, 5, 0), ('zz-gone', '', 1, 6, 0)) t(k, v, op, seqno, pos))"""


def _seen(where: str = "true") -> str:
    return f"""seen as (select k, v, seqno from (
  select *, row_number() over (partition by k order by seqno desc, pos desc) n from stored where {where}) where n = 1 and op = 0)"""


def _stored(spark: SparkSession, sf_dir: str, path: str, config: Config = Config()) -> Store:
    log = _log(spark, sf_dir)
    db = Store(spark, path, config)
    for part in range(3):
        db.append(log.where((F.col("seqno") - 1) % 3 == part).withColumn("batch_pos", F.expr("(seqno - 1) div 3")))
    db.write(batches.WriteBatch().put(b"user-0000000002", b"batch").delete(b"user-0000000005").put(b"zz-new", b"1").put(b"zz-new", b"2"))
    db.put(b"user-0000000002", b"put")
    db.delete(b"zz-gone")
    return db


def _text(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), "seqno", *more)


@_query(f"with {STORED}, {_seen()} select k, v, seqno from seen")
def store_scan_reopened(spark, sf_dir):
    """Bulk appends, a batch, a put and a delete; the store is opened again, and replays its log."""
    with scratch(spark) as path:
        _stored(spark, sf_dir, path)
        return checkpointed(_text(Store(spark, path).scan_all()))


@_query(f"with {STORED}, {_seen('seqno <= 2')} select k, v, seqno from seen")
def store_scan_at_snapshot(spark, sf_dir):
    with scratch(spark) as path:
        db = _stored(spark, sf_dir, path)
        db.flush()
        return checkpointed(_text(db.scan_all(2)))


@_query(f"with {STORED}, {_seen()} select k, v, seqno from seen where k >= '{LOW}' and k < '{HIGH}'")
def store_range_flushed(spark, sf_dir):
    with scratch(spark) as path:
        _stored(spark, sf_dir, path).flush()
        return checkpointed(_text(Store(spark, path).range(LOW.encode(), HIGH.encode())))


@_query(f"with {STORED} select k, v, seqno, op::int op, pos from stored")
def store_compacted(spark, sf_dir):
    """Flushed, merged into one run and opened again: every version is there once."""
    with scratch(spark) as path:
        db = _stored(spark, sf_dir, path)
        db.flush()
        db.compact()
        db.vacuum()
        rows = Store(spark, path).log()
        return checkpointed(_text(rows, F.col("op").cast("int").alias("op"), F.col("batch_pos").alias("pos")))


@_query(
    f"with {STORED}, above as (select * from stored where seqno > 4), below as (select *, row_number() over (partition by k order by seqno desc, pos desc) n from stored where seqno <= 4) "
    "select k, v, seqno, op::int op, pos from above union all select k, v, seqno, op::int op, pos from below where n = 1 and op = 0"
)
def store_compacted_to_floor(spark, sf_dir):
    with scratch(spark) as path:
        db = _stored(spark, sf_dir, path)
        db.flush()
        db.compact(floor=4)
        return checkpointed(_text(db.log(), F.col("op").cast("int").alias("op"), F.col("batch_pos").alias("pos")))


@_query(f"with {STORED} select 1::bigint run_id, count(*)::bigint records, min(k) min_key, max(k) max_key, min(seqno)::bigint min_seqno, max(seqno)::bigint max_seqno from stored where seqno = 1 "
        "union all select 4, count(*), min(k), max(k), min(seqno), max(seqno) from stored where seqno > 3")
def store_run_metadata(spark, sf_dir):
    """The manifest's bounds of the first run and of the one that the log was flushed to."""
    with scratch(spark) as path:
        db = _stored(spark, sf_dir, path)
        db.flush()
        rows = db.run_metadata().where("run_id in (1, 4)")
        text = [F.unhex(c).cast("string").alias(c) for c in ("min_key", "max_key")]
        return checkpointed(rows.select("run_id", "records", *text, "min_seqno", "max_seqno"))


@_query(f"with {STORED}, {_seen()} select k, v, seqno, true wrong_key_refused, true hidden from seen")
def store_encrypted(spark, sf_dir):
    """An encrypted store, flushed and merged: another key is refused and changes nothing, and no value is in the files."""
    with scratch(spark) as path:
        key = Config(encryption=SecretKey(bytes(range(32))))
        db = _stored(spark, sf_dir, path, key)
        db.flush()
        refused = False
        try:
            Store(spark, path, Config(encryption=SecretKey(bytes(32)))).compact()
        except AuthenticationError:
            refused = True
        db.compact()
        raw = spark.read.parquet(f"{path}/runs/*").select("value")
        hidden = raw.where(F.octet_length("value") < 28).count() == 0 and raw.where(F.instr(F.hex("value"), F.hex(F.lit("batch"))) > 0).count() == 0
        return checkpointed(_text(Store(spark, path, key).scan_all(), F.lit(refused).alias("wrong_key_refused"), F.lit(hidden).alias("hidden")))


@_query(f"with {LOG}, {_visible()} select k, v, 1::bigint seqno from vis")
def store_stream(spark, sf_dir):
    """The events as a stream into a store: one micro-batch, delivered twice."""
    with scratch(spark) as path:
        db = Store(spark, f"{path}/db")
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        # the table is a file here and a folder there; a stream reads a folder
        _log(spark, sf_dir).select("key", "op", "value", "seqno").coalesce(1).write.parquet(f"{path}/in")
        stream = spark.readStream.schema("key string, op tinyint, value string, seqno long").parquet(f"{path}/in")
        ops = stream.select("key", "op", "value", F.col("seqno").alias("place"))
        ingest(ops, db, f"{path}/check", "place").awaitTermination()
        again = _log(spark, sf_dir).limit(0 if events.isEmpty() else 1)
        db.append(again, 0)
        return checkpointed(_text(db.scan_all()))


@_query(f"with {LOG}, b as (select run, (seqno - 1) // 50 + 1 seqno, ((seqno - 1) % 50)::int pos, op, k, v from log) select run, seqno, pos, op::int op, k, v from b")
def log_segments_read(spark, sf_dir):
    """The events in batches, as log segments of 32 KiB blocks; read again record by record and decoded."""
    files = wal.segments(batched(_log(spark, sf_dir), 50), rotate_at=100_000)
    found = wal.outcomes(files.select(F.format_string("%d-%d", "run_id", "segment").alias("path"), "content"))
    rows = batches.decoded(found.where("outcome = 'record'").withColumn("run", F.split("path", "-")[0].cast("long")), also=("run",))
    return rows.where("error is null").select("run", "seqno", F.col("batch_pos").alias("pos"), F.col("op").cast("int").alias("op"), F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@_query(f"with {LOG} select run, count(distinct (seqno - 1) // 50)::bigint records, 1::bigint ends, 0::bigint torn, 1::bigint cut_torn from log group by run")
def log_segment_outcomes(spark, sf_dir):
    """Outcomes of each run's segment: whole, and without its last byte."""
    files = checkpointed(wal.segments(batched(_log(spark, sf_dir), 50)).select(F.col("run_id").cast("string").alias("path"), "content"))
    cut = files.withColumn("content", F.expr("substring(content, 1, length(content) - 1)"))
    kinds = [F.count(F.when(F.col("outcome") == kind, 1)).alias(name) for kind, name in (("record", "records"), ("end", "ends"), ("torn", "torn"))]
    own = wal.outcomes(files).groupBy("path").agg(*kinds)
    torn = wal.outcomes(cut).groupBy("path").agg(F.count(F.when(F.col("outcome") == "torn", 1)).alias("cut_torn"))
    return own.join(torn, "path").select(F.col("path").cast("long").alias("run"), "records", "ends", "torn", "cut_torn")


_LENGTH = "case when strlen({0}) < 128 then 1 when strlen({0}) < 16384 then 2 else 3 end + strlen({0})"


@_query(f"with {LOG}, b as (select (seqno - 1) // 50 + 1 seqno, op, k, v from log) select seqno, (case when count(*) < 128 then 1 else 2 end + sum(1 + {_LENGTH.format('k')} + case when op = 0 then {_LENGTH.format('v')} else 0 end))::bigint bytes, count(*)::bigint ops from b group by seqno")
def batch_encoding(spark, sf_dir):
    """Length of each batch's encoding, and the number of operations that are decoded from it."""
    payloads = checkpointed(batches.encoded(batched(_log(spark, sf_dir), 50)))
    ops = batches.decoded(payloads).where("error is null").groupBy("seqno").agg(F.count("*").alias("ops"))
    return payloads.join(ops, "seqno").select("seqno", F.octet_length("payload").cast("long").alias("bytes"), "ops")


@_query(f"with {LOG} select run, k, v, seqno, op::int op from log")
def table_files_read(spark, sf_dir):
    """The events as sorted-table files of checked blocks, read again."""
    files = sstable.tables(_log(spark, sf_dir), file_bytes=200_000, block_size=4096)
    rows = sstable.records(files.select(F.format_string("%d-%d", "run_id", "part").alias("path"), "content")).where("error is null")
    return _text(rows, F.split("path", "-")[0].cast("long").alias("run"), F.col("op").cast("int").alias("op"))


@_query(f"with {LOG} select run, k, v, seqno, op::int op, true wrong_key_refused from log")
def table_files_sealed(spark, sf_dir):
    """Table files whose blocks are sealed, read with their key; another key reads none of them."""
    key = SecretKey(bytes(range(32)))
    files = checkpointed(sstable.tables(_log(spark, sf_dir), file_bytes=400_000, key=key).withColumn("path", F.col("run_id").cast("string")))
    refused = sstable.records(files, SecretKey(bytes(32))).where("error is null").isEmpty()
    rows = sstable.records(files, key).where("error is null")
    return _text(rows, F.col("path").cast("long").alias("run"), F.col("op").cast("int").alias("op"), F.lit(refused).alias("wrong_key_refused"))


@_query(f"with {LOG} select run, count(*)::bigint entries, min(seqno) min_seqno, max(seqno) max_seqno, true aligned from log group by run")
def table_file_headers(spark, sf_dir):
    files = sstable.tables(_log(spark, sf_dir)).select(F.col("run_id").cast("string").alias("path"), "content")
    rows = sstable.summaries(files)
    return rows.select(F.col("path").cast("long").alias("run"), "entries", "min_seqno", "max_seqno", (F.col("bytes_written") >= 4096 * (1 + F.col("blocks"))).alias("aligned"))


@_query(f"with {LOG} select run, k, max(seqno) seqno, arg_max(op, seqno)::int op, arg_max(v, seqno) v from log where k in ('{ONE_KEY}', '{LOW}') and seqno <= {SNAPSHOT} group by run, k")
def table_file_gets(spark, sf_dir):
    """What each run's file has for two keys at a snapshot, by its filter, index and blocks; an absent key gives nothing."""
    files = sstable.tables(_log(spark, sf_dir)).select(F.col("run_id").cast("string").alias("path"), "content")
    found = sstable.lookups(files, [ONE_KEY.encode(), LOW.encode(), b"absent"], SNAPSHOT)
    return found.select(F.col("path").cast("long").alias("run"), F.col("key").cast("string").alias("k"), "seqno", "op", F.col("value").cast("string").alias("v"))


#: Three runs that overlap: the same versions in two of them, and in the third others under the same numbers.
TIED = f"""{LOG}, tied as (
  select k, v, seqno, op, 0 src from log where seqno % 2 = 0 union all select k, v, seqno, op, 1 from log where seqno % 3 = 0
  union all select k, 'other', seqno, 0, 2 from log where seqno % 5 = 0)"""


def _tied(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    log = _log(spark, sf_dir)
    third = log.where("seqno % 5 = 0").withColumn("value", F.lit("other")).withColumn("op", F.lit(0).cast("tinyint"))
    return [log.where("seqno % 2 = 0"), log.where("seqno % 3 = 0"), third]


@_query(f"with {TIED} select k, v, seqno, op::int op, src, row_number() over (order by k, seqno desc, src)::int place from tied")
def merge_tied_runs(spark, sf_dir):
    """Runs that hold the same numbers: the newer run comes first."""
    out = read.numbered(read.merged(_tied(spark, sf_dir)))
    return _out(out, F.col("op").cast("int").alias("op"), F.col("source_rank").alias("src"), F.col("place").cast("int").alias("place"))


@_query(f"with {TIED}, f as (select *, row_number() over (partition by k order by seqno desc, src) n from tied) select k, v, seqno from f where n = 1 and op = 0")
def merge_tied_runs_visible(spark, sf_dir):
    rows = read.merged(_tied(spark, sf_dir)).withColumn("run_id", -F.col("source_rank"))
    return _out(read.visible(rows))


@_query(f"with {TIED} select src, count(*)::bigint records from tied group by src")
def merge_input_counts(spark, sf_dir):
    return read.merged(_tied(spark, sf_dir)).groupBy(F.col("source_rank").alias("src")).agg(F.count("*").alias("records"))


@_query("""select o_orderkey, o_orderkey plain, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::int size, o_orderkey padded, null::bigint canonical, null::bigint cut from orders""")
def varint_decode(spark, sf_dir):
    """Encodings read again: as they are, padded by a byte, padded where only the shortest form counts, and cut."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", varint.encoded(F.col("o_orderkey").cast("long")).alias("e"))
    size = F.length("e")
    high = F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("e", size, F.lit(1))), 16, 10).cast("long") + 128), 2, "0"))
    start = F.substring("e", F.lit(1), size - 1)
    padded, cut = F.concat(start, high, F.unhex(F.lit("00"))), F.concat(start, high)
    plain = varint.decoded(F.col("e"))
    return orders.select(
        "o_orderkey", plain["value"].alias("plain"), plain["size"].alias("size"), varint.decoded(padded)["value"].alias("padded"),
        varint.decoded(padded, canonical=True)["value"].alias("canonical"), varint.decoded(cut)["value"].alias("cut"),
    )


@_query(f"with {LOG}, {_visible()}, page as (select * from vis where k >= '{LOW}' and k < '{HIGH}' order by k limit 10) select base64(k::blob) k, base64(v::blob) v, seqno from page")
def b64_bounded_page(spark, sf_dir):
    """The response to a scan whose bounds come in base64, a row for each record."""
    import base64

    bounds = read.from_base64(*(base64.b64encode(x.encode()).decode() for x in (LOW, HIGH)))
    log = _log(spark, sf_dir).withColumn("key", F.col("key").cast("binary"))
    page = read.response(log, *bounds, limit=10).select(F.explode("records").alias("r"))
    return page.select(F.col("r.key").alias("k"), F.col("r.value").alias("v"), F.col("r.seqno").alias("seqno"))
