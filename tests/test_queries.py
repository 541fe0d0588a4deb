"""Registered queries against their SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as registry
from derivata.plans import queries as core

SCALAR = (int, str, bool, type(None))


def value(x):
    if isinstance(x, SCALAR):
        return x
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return None if math.isnan(x) else round(float(x), 6)
    return str(x)


@pytest.fixture(scope="module")
def tables(tiny):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{tiny}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, tiny, tables, name):
    df = registry.queries()[name](spark, tiny)
    names = sorted(df.columns)
    want = tables.sql(core.SQL[name])
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    key = lambda row: [(x is None, str(x)) for x in row]
    assert sorted(([value(r[n]) for n in names] for r in df.collect()), key=key) == sorted(([value(r[i]) for i in at] for r in want.fetchall()), key=key)


def test_entry_and_registry(spark):
    assert registry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_plans_read_only_what_they_need(spark, tiny):
    plan = registry.queries()["registration_conflicts"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = registry.queries()["latest_row"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "props" not in plan


def test_scoring_reads_no_truth(spark, tiny):
    plan = registry.queries()["retrieval_top_k"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan
