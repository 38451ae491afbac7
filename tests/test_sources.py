"""Stores, log segments and table files: round trips, restarts, damage."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.batches import FormatError, WriteBatch, decoded
from tidemark.functions.crypto import AuthenticationError, SecretKey
from tidemark.operators import read
from tidemark.sources import sstable, store, wal
from tidemark.sources.fs import Files
from tidemark.sources.store import Config, Store, parse_log_name, parse_run_name
from tidemark.sources.wal import CorruptionError
from tidemark.streaming.ingest import ingest


def out(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def test_store_life(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Store(spark, path)
    assert out(db.scan_all()) == [] and db.compact() == 0
    db.put(b"a", b"1")
    snap = db.put(b"b", b"1")
    db.write(WriteBatch().put(b"a", b"2").put(b"c", b"3").delete(b"c"))
    assert db.get(b"a") == b"2" and db.get(b"c") is None and db.get(b"a", snap) == b"1"
    db = Store(spark, path)  # what was logged is read again
    assert out(db.scan_all()) == [(b"a", b"2"), (b"b", b"1")] and db.snapshot() == 3
    db.flush()
    db.flush()
    assert db.statistics() == {"run_count": 1, "current_seqno": 3, "encrypted": False}
    db.delete(b"b")
    db.write(WriteBatch())
    db.put(b"", b"")
    assert db.get(b"b") is None and db.get(b"b", snap) == b"1" and db.get(b"") == b""
    db.flush()
    reader = Store(spark, path)
    before = reader.scan_all()
    assert db.compact() == 7 and db.statistics()["run_count"] == 1
    assert out(before) == out(db.scan_all()) == [(b"", b""), (b"a", b"2")]
    assert db.get(b"a", snap) == b"1" and db.get(b"b", snap) == b"1"
    assert out(db.range(b"a", b"b")) == [(b"a", b"2")]
    assert {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in db.multi_get([b"a", b"zz"]).collect()} == {b"a": b"2", b"zz": None}
    db.vacuum()
    db = Store(spark, path)
    assert out(db.scan_all()) == [(b"", b""), (b"a", b"2")] and db.snapshot() == 6
    assert db.run_metadata().first()["records"] == 7


def test_replay_after_flush_changes_nothing(spark, tmp_path):
    """A log that outlives its flush is older than the manifest's number."""
    db = Store(spark, str(tmp_path / "db"))
    db.put(b"k", b"old")
    kept = db.files.read("wal/wal-00000001.log")
    db.flush()
    db.put(b"k", b"new")
    db.flush()
    db.files.publish("wal/wal-00000001.log", kept)
    db = Store(spark, str(tmp_path / "db"))
    assert db.get(b"k") == b"new" and db.snapshot() == 2 and db.logged == []


def test_bulk_append_and_prune(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"), Config(partition_bytes=4096))
    for n in range(3):
        db.append(spark.createDataFrame([(b"k-%04d" % i, 0, b"v%d" % n) for i in range(300)], "key binary, op int, value binary"))
    assert db.compact(floor=3) == 300
    assert len(out(db.scan_all())) == 300 and db.get(b"k-0007") == b"v2"


def test_runs_are_written_by_many_tasks(spark, tmp_path):
    """A frequent key is in several ranges, rows bound a range as bytes do, and a run of one range is made in as many tasks as its rows come in."""

    def sizes(db):
        rows = spark.read.parquet(f"{db.files.root}/runs/*")
        return [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]

    ops = spark.range(0, 2000, 1, 4).select(F.lit(b"hot").alias("key"), F.lit(0).alias("op"), F.spark_partition_id().cast("string").cast("binary").alias("value"), F.col("id").cast("int").alias("batch_pos"))
    one, by_bytes, by_rows = (Store(spark, str(tmp_path / n), c) for n, c in (("one", Config()), ("bytes", Config(partition_bytes=8192)), ("rows", Config(partition_rows=500))))
    for db in (one, by_bytes, by_rows):
        db.append(ops)
        assert out(db.scan_all()) == [(b"hot", b"3")] and db.log().count() == sum(sizes(db)) == 2000
    assert len(sizes(one)) == 1 and one.log().select("value").distinct().count() == 4
    assert len(sizes(by_bytes)) >= 5 and max(sizes(by_bytes)) < 800
    assert len(sizes(by_rows)) == 4 and max(sizes(by_rows)) < 1000


def test_rotation(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"), Config(memtable_bytes=100))
    db.put(b"k", b"x" * 200)
    assert db.statistics()["run_count"] == 1 and db.logged == []


def test_encrypted_store(spark, tmp_path):
    key = SecretKey(b"k" * 32)
    db = Store(spark, str(tmp_path / "db"), Config(encryption=key))
    db.write(WriteBatch().put(b"a", b"top secret value").put(b"b", b""))
    db.flush()
    db.put(b"c", b"3")
    db.flush()
    assert out(db.scan_all()) == [(b"a", b"top secret value"), (b"b", b""), (b"c", b"3")]
    db.compact()
    assert db.get(b"a") == b"top secret value"
    raw = spark.read.parquet(str(tmp_path / "db/runs/*"))
    assert not any(b"secret" in bytes(r["value"]) for r in raw.collect())
    with pytest.raises(FormatError):
        Store(spark, str(tmp_path / "db"))
    Store(spark, str(tmp_path / "plain"))
    with pytest.raises(FormatError):
        Store(spark, str(tmp_path / "plain"), Config(encryption=key))


def test_a_wrong_key_is_refused_and_changes_nothing(spark, tmp_path):
    path, right, wrong = str(tmp_path / "db"), SecretKey(b"k" * 32), SecretKey(b"x" * 32)
    db = Store(spark, path, Config(encryption=right))
    for k in (b"a", b"b"):
        db.put(k, b"value " + k)
        db.flush()
    with pytest.raises(AuthenticationError):
        Store(spark, path, Config(encryption=wrong))
    # even an instance that holds a wrong key can't read, or compact
    broken = Store(spark, path, Config(encryption=right))
    broken.config = Config(encryption=wrong)
    for action in (lambda: broken.scan_all().collect(), broken.compact):
        with pytest.raises(Exception, match="authentication"):
            action()
    db = Store(spark, path, Config(encryption=right))
    assert out(db.scan_all()) == [(b"a", b"value a"), (b"b", b"value b")]
    assert db.compact() == 2 and out(db.scan_all()) == [(b"a", b"value a"), (b"b", b"value b")]


def test_sealed_values_are_bound_to_their_records(spark, tmp_path):
    path = str(tmp_path / "db")
    key = SecretKey(b"k" * 32)
    db = Store(spark, path, Config(encryption=key))
    db.write(WriteBatch().put(b"a", b"1").put(b"b", b"2"))
    db.flush()
    folder = db.manifest.runs[0]["folder"]
    rows = spark.read.parquet(f"{path}/runs/{folder}").collect()
    swapped = [(bytes(r["key"]), r["seqno"], r["op"], bytes(o["value"]), r["batch_pos"]) for r, o in zip(rows, rows[::-1])]
    assert len({bytes(r["value"])[:12] for r in rows}) == 2
    spark.createDataFrame(swapped, "key binary, seqno long, op tinyint, value binary, batch_pos int").write.mode("overwrite").parquet(f"{path}/runs/{folder}")
    with pytest.raises(Exception, match="authentication"):
        Store(spark, path, Config(encryption=key)).scan_all().collect()
    assert not list((tmp_path / "db").glob("drafts/*"))


def test_compaction_opens_each_value_once(spark, tmp_path, monkeypatch):
    """Rows are counted, sampled and moved sealed."""
    db = Store(spark, str(tmp_path / "db"), Config(encryption=SecretKey(b"k" * 32), partition_bytes=4096))
    for n in range(3):
        db.append(spark.createDataFrame([(b"k-%04d" % i, 0, b"v%d" % n) for i in range(300)], "key binary, op int, value binary"))
    opened, unseal = spark.sparkContext.accumulator(0), store.unseal_records

    @F.udf("binary")
    def counted(value):
        opened.add(1)
        return value

    monkeypatch.setattr(store, "unseal_records", lambda *args: unseal(*args).withColumn("value", counted.asNondeterministic()("value")))
    assert db.compact() == 900 and opened.value == 900
    monkeypatch.undo()
    rows = {(bytes(r["key"]), r["seqno"], bytes(r["value"])) for r in db.log().collect()}
    assert rows == {(b"k-%04d" % i, n + 1, b"v%d" % n) for i in range(300) for n in range(3)}


def test_pruning_drops_no_value_that_is_not_authentic(spark, tmp_path):
    path, key = str(tmp_path / "db"), Config(encryption=SecretKey(b"k" * 32))
    db = Store(spark, path, key)
    for value in (b"1", b"2"):
        db.put(b"a", value)
        db.flush()
    folder = f"{path}/runs/{db.manifest.runs[0]['folder']}"
    rows = [tuple(r) for r in spark.read.parquet(folder).collect()]
    # the newest version is made a tombstone, which pruning would drop
    spark.createDataFrame([(k, n, 1, v, p) for k, n, _, v, p in rows], "key binary, seqno long, op tinyint, value binary, batch_pos int").write.mode("overwrite").parquet(folder)
    with pytest.raises(Exception, match="authentication"):
        Store(spark, path, key).compact(floor=2)
    spark.createDataFrame(rows, "key binary, seqno long, op tinyint, value binary, batch_pos int").write.mode("overwrite").parquet(folder)
    db = Store(spark, path, key)
    assert db.compact(floor=2) == 1 and out(db.scan_all()) == [(b"a", b"2")]


def test_damaged_log_is_never_dropped(spark, tmp_path):
    path = tmp_path / "db"
    db = Store(spark, str(path))
    db.put(b"a", b"1")
    db.put(b"b", b"2")
    segment = path / "wal/wal-00000002.log"
    good = segment.read_bytes()
    (path / "wal/.wal-00000002.log.crc").unlink()  # the local file system's own check
    assert Store.log_damage(spark, str(path)).count() == 0
    for bad in (good[:-1] + bytes([good[-1] ^ 1]), good[:-2], good[:40], b"", good.replace(b"\x02" + bytes(7), b"\x07" + bytes(7))):
        segment.write_bytes(bad)
        with pytest.raises(CorruptionError, match="wal-00000002.log"):
            Store(spark, str(path))
        assert segment.read_bytes() == bad
        (row,) = Store.log_damage(spark, str(path)).collect() or [None]
        assert row["path"].endswith("wal-00000002.log") and row["reason"]
    segment.write_bytes(good)
    db = Store(spark, str(path))
    assert db.get(b"b") == b"2" and db.snapshot() == 2
    db.flush()
    assert not segment.exists() and out(db.scan_all()) == [(b"a", b"1"), (b"b", b"2")]


def test_orphan_run_of_a_crashed_flush(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"))
    db.put(b"a", b"1")
    orphan = db._write_run(db._logged_rows(), db.manifest.next_run)["folder"]  # a crash comes before the manifest
    db = Store(spark, str(tmp_path / "db"))
    db.flush()
    assert out(db.scan_all()) == [(b"a", b"1")]
    assert len(db.files.list("runs")) == 2
    db.vacuum()
    assert db.files.list("runs") == [db.manifest.runs[0]["folder"]] != [orphan]


def test_the_newest_writer_counts(spark, tmp_path):
    old = Store(spark, str(tmp_path / "db"))
    old.put(b"k", b"1")
    new = Store(spark, str(tmp_path / "db"))
    new.put(b"k", b"2")
    for action in (lambda: old.put(b"k", b"3"), old.flush, lambda: old.append(spark.createDataFrame([(b"x", 0, b"1")], "key binary, op int, value binary"))):
        with pytest.raises(FileExistsError):
            action()
    new.flush()
    assert new.get(b"k") == b"2" and new.snapshot() == 2


def test_limits_and_pages(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"), Config(max_key_bytes=4, max_value_bytes=6))
    for key, value in ((b"12345", b""), (b"1", b"1234567")):
        with pytest.raises(FormatError):
            db.put(key, value)
    with pytest.raises(FormatError):
        db.get(b"12345")
    for k in (b"a", b"b", b"c", b"d"):
        db.put(k, k * 3)
    page = db.scan_page("Yg==", "ZA==", 1).first()
    assert [(r["key"], r["value"]) for r in page["records"]] == [("Yg==", "YmJi")] and page["truncated"]
    assert len(db.scan_page().first()["records"]) == 4 and not db.scan_page(limit=4).first()["truncated"]
    with pytest.raises(ValueError):
        db.scan_page("no base64!")


def test_filters_follow_the_configuration(spark, tmp_path):
    sizes = []
    for bits in (0, 4, 20):
        db = Store(spark, str(tmp_path / f"db{bits}"), Config(bits_per_key=bits))
        db.append(spark.createDataFrame([(b"k-%06d" % i, 0, b"") for i in range(20_000)], "key binary, op int, value binary"))
        sizes.append(sum(f.stat().st_size for f in (tmp_path / f"db{bits}").glob("runs/*/part-*")))
    assert sizes[0] < sizes[1] < sizes[2]


def test_two_writers_conflict(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "db")) for _ in range(2))
    one.put(b"k", b"1")
    with pytest.raises(FileExistsError):
        two.put(b"k", b"2")


def test_stream(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"))
    source, schema = tmp_path / "in", "key binary, op int, value binary, pos int"
    spark.createDataFrame([(b"a", 0, b"1", 0), (b"a", 0, b"2", 1), (b"b", 0, b"1", 2)], schema).coalesce(1).write.parquet(str(source))
    for _ in range(2):
        ingest(spark.readStream.schema(schema).parquet(str(source)), db, str(tmp_path / "check"), "pos").awaitTermination(120)
    assert out(db.scan_all()) == [(b"a", b"2"), (b"b", b"1")]
    spark.createDataFrame([(b"b", 1, None, 0)], schema).coalesce(1).write.mode("append").parquet(str(source))
    ingest(spark.readStream.schema(schema).parquet(str(source)), db, str(tmp_path / "check"), "pos").awaitTermination(120)
    assert out(db.scan_all()) == [(b"a", b"2")] and db.snapshot() == 2
    again = spark.createDataFrame([(b"x", 0, b"1", 0)], schema)
    assert db.append(again.withColumnRenamed("pos", "batch_pos"), 0) == 2 and db.get(b"x") is None


def test_names():
    assert parse_log_name("wal-00000012.log") == 12 and parse_log_name("wal-x.log") is None and parse_log_name("00000001.sst") is None
    assert sstable.file_name(7) == "00000007.sst" and [sstable.parse_file_name(n) for n in ("00000007.sst", "7.sst", "x.sst", ".sst", "7.sst.tmp", "wal-00000001.log")] == [7, 7, None, None, None, None]
    assert parse_run_name("00000012-0123456789ab") == 12 and parse_run_name("00000012") is None


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=40_000), max_size=8))
def test_segment_round_trip(payloads):
    segment = wal.SegmentWriter(3, 1)
    starts = [segment.append(i + 1, p) for i, p in enumerate(payloads)]
    got = list(wal.read_segment(bytes(segment.data)))
    assert [(o.seqno, o.payload) for o in got[:-1]] == [(i + 1, p) for i, p in enumerate(payloads)]
    assert got[-1].kind == "end" and starts == sorted(starts)


def test_torn_and_damaged_segments(spark, tmp_path):
    segment = wal.SegmentWriter(1, 1)
    segment.append(1, b"one")
    second = segment.append(2, b"x" * 70_000)
    data = bytes(segment.data)
    for cut in (len(data) - 1, second + 5, second + 40_000):
        got = list(wal.read_segment(data[:cut]))
        assert [o.kind for o in got] == ["record", "torn"] and got[1].truncate_to == second
    damaged = bytearray(data)
    damaged[second + 20] ^= 1
    assert list(wal.read_segment(bytes(damaged)))[-1].reason == "a checksum differs"
    for bad in (b"", data[:31], b"x" + data[1:], data[:24] + b"xxxx" + data[28:]):
        with pytest.raises(FormatError):
            list(wal.read_segment(bad))
    (tmp_path / "good.log").write_bytes(data)
    (tmp_path / "bad.log").write_bytes(b"nonsense")
    got = {(r["path"].rpartition("/")[2], r["outcome"]) for r in wal.read_segments(spark, str(tmp_path)).collect()}
    assert got == {("good.log", "record"), ("good.log", "end"), ("bad.log", "invalid")}


def records(n, versions=1):
    return [(b"key-%05d" % i, 1000 - v, int(i % 9 == 0), b"" if i % 9 == 0 else b"value-%d" % i * (i % 50)) for i in range(n) for v in range(versions)]


@pytest.mark.parametrize("rows", [[], records(1), records(2000), records(40, 60)])
def test_table_round_trip(rows):
    data = sstable.write_table(rows, block_size=2048)
    table = sstable.Table(data)
    assert list(table.scan()) == rows and table.entries == len(rows)
    rng = random.Random(2)
    for key, *_ in rng.sample(rows, min(20, len(rows))):
        for seqno in (1, 941, 970, 1000):
            want = next(((s, o, v) for k, s, o, v in rows if k == key and s <= seqno), None)
            assert table.get(key, seqno) == want
    assert table.get(b"absent", 10**6) is None


def test_table_filter_and_damage(spark, tmp_path):
    rows = records(200)
    data = sstable.write_table(rows)
    table = sstable.Table(data)
    for i in range(1000):
        table.get(b"absent-%d" % i, 10**9)
    assert table.bloom.pruned > 900 and sstable.Table(sstable.write_table(rows, filter_keys=0)).bloom is None
    for at in (0, 20, len(data) - 30, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 0xFF
        with pytest.raises(FormatError):
            sstable.Table(bytes(bad))
    bad = bytearray(data)
    bad[sstable.HEADER_REGION + 9] ^= 1
    with pytest.raises(FormatError):
        list(sstable.Table(bytes(bad)).scan())
    with pytest.raises(ValueError):
        sstable.write_table(rows[::-1])
    (tmp_path / "1.sst").write_bytes(data)
    (tmp_path / "2.sst").write_bytes(bytes(bad))
    got = sstable.read_tables(spark, str(tmp_path)).collect()
    assert sum(r["error"] is None for r in got) == 200 and sum(r["error"] is not None for r in got) == 1
    log = sstable.read_tables(spark, str(tmp_path)).where("error is null")
    assert len(out(read.visible(log))) == sum(r[2] == 0 for r in rows)


def test_files_of_a_log_rotate(spark):
    rows = [(run, s, 0, int(s % 7 == 0), b"key-%04d" % (s * 37 % 200), b"" if s % 7 == 0 else b"v" * (s % 90)) for run in (1, 2) for s in range(1, 400)]
    log = spark.createDataFrame(rows, "run_id long, seqno long, batch_pos int, op tinyint, key binary, value binary").repartition(6)
    want = sorted((r, s, k) for r, s, _, _, k, _ in rows)
    files = wal.segments(log, rotate_at=4000)
    assert files.groupBy("run_id").count().where("count > 3").count() == 2
    named = files.selectExpr("format_string('%d-%d', run_id, segment) path", "content")
    found = wal.outcomes(named).where("outcome = 'record'").selectExpr("*", "cast(split(path, '-')[0] as long) run")
    assert sorted((r["run"], r["seqno"], bytes(r["key"])) for r in decoded(found, also=("run",)).collect()) == want
    files = sstable.tables(log, file_bytes=4000, block_size=1000).selectExpr("format_string('%d-%d', run_id, part) path", "content")
    got = sstable.records(files).collect()
    assert sorted((int(r["path"].split("-")[0]), r["seqno"], bytes(r["key"])) for r in got) == want and files.count() > 6
    for name in {r["path"] for r in got}:
        own = [(bytes(r["key"]), -r["seqno"]) for r in got if r["path"] == name]
        assert own == sorted(own)
    heads = sstable.summaries(files.union(spark.createDataFrame([("bad", b"x")], "path string, content binary"))).collect()
    assert sum(r["entries"] or 0 for r in heads) == len(rows) and [r["entries"] for r in heads if r["path"] == "bad"] == [None]
    hits = {(r["path"].split("-")[0], r["seqno"]) for r in sstable.lookups(files, [b"key-0037", b"no"], 250).collect()}
    assert hits == {("1", 201), ("2", 201)} or hits == {("1", 1), ("2", 1), ("1", 201), ("2", 201)}


def test_records_before_the_damage_are_read(spark):
    data = bytearray(sstable.write_table(records(2000), block_size=2048))
    table = sstable.Table(bytes(data))
    at = table.index[5][1]
    data[at + 9] ^= 1
    files = spark.createDataFrame([("x", bytes(data)), ("y", sstable.write_table(records(50)))], "path string, content binary")
    got = sstable.records(files).collect()
    before = sum(len(list(table.block(i).records())) for i in range(5))
    assert sum(r["error"] is None and r["path"] == "x" for r in got) == before and sum(r["error"] is not None for r in got) == 1
    assert sum(r["path"] == "y" for r in got) == 50


def test_sealed_tables():
    rows, key = records(700), SecretKey(b"k" * 32)
    data = sstable.write_table(rows, block_size=2048, key=key, table_id=9)
    table = sstable.Table(data, key, 9)
    assert list(table.scan()) == rows and table.get(b"key-00123", 10**6)[2] == rows[123][3] and b"value-123" not in data
    for args in ((), (SecretKey(b"x" * 32), 9), (key, 8)):
        with pytest.raises(ValueError):
            list(sstable.Table(data, *args).scan())
    with pytest.raises(FormatError):
        sstable.Table(sstable.write_table(rows), key)
    # blocks that change places don't open
    (_, a, n, _), (_, b, m, _) = table.index[2:4]
    moved = bytearray(data)
    size = min(n, m)
    moved[a : a + size], moved[b : b + size] = data[b : b + size], data[a : a + size]
    with pytest.raises(ValueError):
        list(sstable.Table(bytes(moved), key, 9).scan())


def test_files_by_place(spark, tmp_path):
    files = Files(spark, str(tmp_path / "x"))
    files.publish("a/b", b"0123456789")
    assert files.size("a/b") == 10 and files.exists("a/b") and not files.exists("a/c")
    assert (files.read_at("a/b", 3, 4), files.read_at("a/b", 8, 99), files.read_at("a/b", 50, 1)) == (b"3456", b"89", b"")
    with pytest.raises(FileExistsError):
        files.create("a/b", b"")
    for bad in ("/etc/x", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            files.read(bad)
