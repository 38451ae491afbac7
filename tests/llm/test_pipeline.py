"""The pipeline's stages, each against brute force on its own input, and the registered queries' contracts."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from tidemark.llm import common, mixing, queries

from .helpers import documents, near_components, words

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    bench = {r["item_id"]: " ".join(words(r["text"], True)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    item = next(t for t in bench.values())
    odd = documents(spark, [(9000, None), (9001, "..."), (9002, "Before it " + item + " after it"), (9003, "the of and that was it"), (9003, "the of and that was it")])
    docs, frames = table.unionByName(odd), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        frames.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{name}")))
        if name != "sharding":
            assert frames[-1][1].columns == table.columns
        docs = frames[-1][1]
    start, out = frames[0][0], frames[0][1].collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in start if any(map(str.isalpha, r["text"] or "")))
    start, out = frames[1][0], [r["doc_id"] for r in frames[1][1].collect()]
    assert sorted(out) == sorted({c for _, c in near_components([(r["doc_id"], r["text"]) for r in start]).values()})
    start, out = frames[2][0], {r["doc_id"] for r in frames[2][1].collect()}
    held = {r["doc_id"] for r in start if any(f" {t} " in f" {' '.join(words(r['text'], True))} " for t in bench.values())}
    assert 9002 in held and not held & out and len(out) > 0.9 * (len(start) - len(held))
    start, out = frames[3][0], frames[3][1].collect()
    assert sum(len(words(r["text"])) for r in out) == mixing.mix(spark.read.parquet(f"{tmp_path}/{pipeline.STAGES[2][0]}")).groupBy().sum("taken").first()[0]
    start, out = frames[4][0], frames[4][1].collect()
    assert sorted(r["doc_id"] for r in start) == sorted(r["doc_id"] for r in out) and {r["shard"] for r in out} <= set(range(24))
    assert len(set((r["shard"], r["slot"]) for r in out)) == len(out)


def test_odd_inputs_of_the_stages(spark, tmp_path):
    """Empty tables, columns that clash with the stages' own, a very long text, and rows that are repeated."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    clash = {"shard": 1, "slot": "x", "size": None, "row": 2.5, "component_id": "c", "similarity": 0, "lang_pred": "p", "_row": 1, "epoch": 3}
    odd = documents(spark, [(9000, "the of and that was it " * 40_000), (9001, None), (None, "the of and that was it"), (None, "the of and that was it"), (9003, "")])
    full = table.limit(60).unionByName(odd)
    for name, value in clash.items():
        full = full.withColumn(name, F.lit(value))
    bench = spark.createDataFrame([], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    for docs, folder in ((full, SF), (full, f"{tmp_path}/empty"), (full.limit(0), SF)):
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, folder)
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            assert set(docs.columns) == set(columns), name
        if docs.count():
            assert {r["doc_id"] for r in docs.collect()} >= {9000, None} and docs.where("doc_id = 9000 and length(text) > 800000").count() >= 1


def test_run_removes_what_it_has_read(spark, tmp_path):
    before = set(glob.glob(f"{common.shared_dir(spark).removeprefix('file:')}/pipeline-*/*"))
    rows = pipeline.run(spark, SF)
    left = set(glob.glob(f"{common.shared_dir(spark).removeprefix('file:')}/pipeline-*/*")) - before
    assert [p.rpartition("/")[2] for p in left] == ["mixing"] and rows.count() > 100


def test_names():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    rows = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    r = c.sql(queries.ORACLE_SQL[name])
    want = [dict(zip(r.columns, row)) for row in r.fetchall()]
    key = lambda row: repr(sorted(row.items()))
    assert sorted(map(key, rows)) == sorted(map(key, want))
