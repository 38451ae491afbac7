"""The driver's contract: every engine query agrees with its SQL."""

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark.plans import queries as engine

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, name):
    df = engine.QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name not in engine.ORACLE_SQL:
        assert got
        return
    c = duckdb.connect()
    for t in ("events", "orders", "customer"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    r = c.sql(engine.ORACLE_SQL[name])
    want = [dict(zip(r.columns, row)) for row in r.fetchall()]
    key = lambda row: repr(sorted(row.items()))
    assert sorted(map(key, got)) == sorted(map(key, want))
