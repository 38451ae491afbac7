"""Reads against a dictionary model, and the order of operations."""

import random

import pytest

from tidemark.operators import maintain, read
from tidemark.operators.log import LOG_SCHEMA


def make(spark, rows):
    """rows: (key, seqno, op, value[, batch_pos[, run_id]])."""
    full = [(*r, *(0, 0)[len(r) - 4 :]) for r in rows]
    return spark.createDataFrame([(bytes(k), s, o, bytes(v), p, n) for k, s, o, v, p, n in full], LOG_SCHEMA)


def model(rows, seqno=None):
    state = {}
    for k, s, o, v, *rest in sorted(rows, key=lambda r: (r[1], *r[4:])):
        if seqno is None or s <= seqno:
            state[k] = (o, v, s)
    return [(k, v, s) for k, (o, v, s) in sorted(state.items()) if o == 0]


def out(df):
    return [(bytes(r["key"]), bytes(r["value"]), r["seqno"]) for r in df.collect()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    keys = [b"", b"\x00", b"a", b"a\x00", b"b", b"\x7f", b"\x80", b"\xff", b"\xff\xff"]
    return [(rng.choice(keys), s, int(rng.random() < 0.3), b"" if s % 7 == 0 else b"v%d" % s) for s in range(1, 200)]


@pytest.mark.parametrize("seqno", [None, 0, 1, 50, 120, 10_000])
def test_visible_is_the_model(spark, rows, seqno):
    rows = [(k, s, o, b"" if o else v) for k, s, o, v in rows]
    assert out(read.scan_all(make(spark, rows), seqno)) == model(rows, seqno)
    assert sorted(out(read.newest_by_max(make(spark, rows), seqno).where("op = 0"))) == model(rows, seqno)


def test_bounds(spark, rows):
    log, everything = make(spark, rows), model(rows)
    for lo, hi in [(b"a", b"\x80"), (b"", b"\xff"), (b"\x80", b"a"), (b"a", b"a")]:
        for lo_in in (True, False):
            for hi_in in (True, False):
                want = [r for r in everything if (r[0] >= lo if lo_in else r[0] > lo) and (r[0] <= hi if hi_in else r[0] < hi)]
                assert out(read.range_bounds(log, read.Bound(lo, lo_in), read.Bound(hi, hi_in))) == want
    assert out(read.range_bounds(log, end=read.excluded(b"b"))) == [r for r in everything if r[0] < b"b"]
    assert out(read.prefix_scan(log, b"a")) == [r for r in everything if r[0].startswith(b"a")]
    assert out(read.prefix_scan(log, b"\xff")) == [r for r in everything if r[0].startswith(b"\xff")]


def test_half_open_range(spark):
    log = make(spark, [(bytes([c]), i + 1, 0, b"x") for i, c in enumerate(b"abcdefg")])
    assert [r[0] for r in out(read.key_range(log, b"c", b"f"))] == [b"c", b"d", b"e"]


def test_tombstone_after_ranking_and_snapshot_before(spark):
    log = make(spark, [(b"k", 1, 0, b"old"), (b"k", 2, 1, b""), (b"k", 3, 0, b"new")])
    assert out(read.get(log, b"k", 1)) == [(b"k", b"old", 1)]
    assert out(read.get(log, b"k", 2)) == []
    assert out(read.get(log, b"k")) == [(b"k", b"new", 3)]


def test_ties(spark):
    """The last operation of a batch counts; of equal records the newer run's."""
    log = make(spark, [(b"k", 5, 0, b"1", 0, 0), (b"k", 5, 1, b"", 1, 0), (b"k", 5, 0, b"3", 2, 0)])
    assert out(read.visible(log)) == [(b"k", b"3", 5)]
    log = make(spark, [(b"X", 7, 0, b"older", 0, 1), (b"X", 7, 0, b"newer", 0, 2)])
    assert out(read.visible(log)) == [(b"X", b"newer", 7)]


def test_many_versions_of_a_key(spark):
    """More versions than a restart interval or a block would hold."""
    log = make(spark, [(b"k", s, 0, b"%d" % s) for s in range(1, 60)])
    assert [out(read.get(log, b"k", s)) for s in (1, 17, 59)] == [[(b"k", b"%d" % s, s)] for s in (1, 17, 59)]


def test_multi_get(spark, rows):
    keys = [b"a", b"nope", b"\xff", b""]
    got = {bytes(r["key"]): r["value"] for r in read.multi_get(make(spark, rows), spark.createDataFrame([(k,) for k in keys], "key binary")).collect()}
    live = {k: v for k, v, _ in model(rows)}
    assert {k: None if v is None else bytes(v) for k, v in got.items()} == {k: live.get(k) for k in keys}


def test_pages(spark, rows):
    log, everything = make(spark, rows), model(rows)
    for limit in (0, 1, len(everything), len(everything) + 1):
        got = read.response(log, limit=limit).first()
        assert len(got["records"]) == min(limit, len(everything)) and got["truncated"] == (limit < len(everything))
    page = read.page(log, limit=2).collect()
    assert [bytes(r["key"]) for r in page] == [k for k, *_ in everything[:2]] and all(r["truncated"] for r in page)


def test_empty(spark):
    log = make(spark, [])
    assert out(read.scan_all(log)) == [] and read.snapshot(log) == 0
    assert maintain.statistics(log).first() == (0, 0)


def test_pruning_keeps_reads_at_and_above_the_floor(spark, rows):
    rows = [(k, s, o, b"" if o else v) for k, s, o, v in rows]
    log = make(spark, rows)
    kept = maintain.pruned(log, 100)
    assert kept.count() < log.count()
    for seqno in (100, 101, 150, 199):
        assert out(read.scan_all(kept, seqno)) == model(rows, seqno)


def test_compaction_keeps_every_version(spark):
    runs = [make(spark, [(b"k-%03d" % i, shard * 1000 + i, 0, b"v", 0, shard) for i in range(200)]) for shard in range(5)]
    merged = maintain.compacted(runs)
    assert merged.count() == 1000
    assert {r[2] // 1000 for r in out(read.visible(merged))} == {4}
    ordered = [(bytes(r["key"]), -r["seqno"]) for r in read.merged(runs[::-1]).collect()]
    assert ordered == sorted(ordered) and len(ordered) == 1000


def test_numbered(spark):
    got = read.numbered(spark.range(1000).repartition(7).orderBy("id")).collect()
    assert all(r["place"] == r["id"] + 1 for r in got) and len(got) == 1000


def test_plans(spark, tmp_path, rows):
    """Bounds and snapshots reach the scan; versions are cut before the shuffle."""
    make(spark, rows).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    df = read.range_bounds(log, read.included(b"a"), read.excluded(b"b"), 50)
    plan = df._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(key" in pushed and "LessThan(key" in pushed and "seqno" in pushed
    assert "WindowGroupLimit" in plan


def test_scan_in_base64_is_whole(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.plans import queries

    n = F.col("id").cast("string")
    log = spark.range(10_005).select(n.alias("key"), "id", F.lit(read.PUT).alias("op"), n.alias("value"), F.lit(0).alias("batch_pos"), F.lit(0).alias("run_id")).withColumnRenamed("id", "seqno")
    monkeypatch.setattr(queries, "_log", lambda *_: log)
    assert queries.b64_scan_page(spark, "").count() == 10_005


def test_prefixes_at_the_edges_of_characters(spark):
    keys = ["a\U0010ffff", "a\U0010ffffz", "b", "\ud7ff", "\ud7ffx", "\ue000", "\U0010ffff", "\U0010ffff!"]
    log = spark.createDataFrame([(k, i + 1, 0, k) for i, k in enumerate(keys)], "key string, seqno long, op int, value string")
    for prefix in ("a\U0010ffff", "\ud7ff", "\U0010ffff", "a", ""):
        assert {r["key"] for r in read.prefix_scan(log, prefix).collect()} == {k for k in keys if k.startswith(prefix)}


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_over_ranges(spark, parts):
    """Neighbours of sorted rows, of which one key has most, in ranges of any number."""
    rows = [(0 if i % 3 else i, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "k long, i long").repartitionByRange(parts, "k", "i").sortWithinPartitions("k", "i")
    want = sorted(rows)
    for step in (1, -1):
        got = read.with_neighbour(frame, ["k", "i"], step, "near", place="place").collect()
        assert len(got) == 500
        for r in got:
            at = r["place"] - 1
            other = want[at + step] if 0 <= at + step < 500 else None
            assert want[at] == (r["k"], r["i"]) and (tuple(r["near"]) if r["near"] else None) == other
    assert read.with_neighbour(frame.limit(0), ["k"], 1, "near").count() == 0


def test_pruning_is_what_intervals_say(spark, rows):
    log = make(spark, [(k, s // 3, o, v, s % 3) for k, s, o, v in rows])
    key = lambda r: (bytes(r["key"]), r["seqno"], r["batch_pos"])
    versions = sorted(map(key, log.collect()))
    until = {a: b[1] if b[0] == a[0] else None for a, b in zip(versions, [*versions[1:], (None, None, None)])}
    got = maintain.with_intervals(log).collect()
    assert {key(r): r["until"] for r in got} == until and len(got) == len(versions)
    ops = {key(r): r["op"] for r in log.collect()}
    for floor in (0, 20, 1000):
        want = [v for v in versions if (until[v] is None or until[v] > floor) and not (ops[v] == 1 and v[1] <= floor)]
        assert sorted(map(key, maintain.pruned(log, floor).collect())) == want


def test_blocks_and_prefixes_by_ranges(spark):
    """A run of most rows is not gathered in a task: no window goes by run."""
    log = make(spark, [(b"key-%04d" % (i % 300), i + 1, 0, b"v", 0, 0 if i % 9 else 1) for i in range(900)])
    ordered = sorted((r["run_id"], bytes(r["key"]), -r["seqno"]) for r in log.collect())
    want, stored = {}, {}
    for run in (0, 1):
        keys = [k for n, k, _ in ordered if n == run]
        for i, k in enumerate(keys):
            records, last = want.get((run, i // 64), (0, b""))
            want[run, i // 64] = (records + 1, max(last, k))
            shared = 0 if i % 16 == 0 else next((j for j in range(8) if keys[i - 1][j] != k[j]), 8)
            stored[run] = stored.get(run, 0) + 8 - shared
    assert {(r["run_id"], r["block"]): (r["records"], bytes(r["last_key"])) for r in maintain.block_index(log, 64).collect()} == want
    df = maintain.prefix_compression(log)
    assert {r["run_id"]: r["stored_bytes"] for r in df.collect()} == stored
    assert "windowspecdefinition(run_id" not in df._jdf.queryExecution().toString()
