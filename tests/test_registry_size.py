"""Queries over a registry that is larger than the small tables', and whose names repeat."""

import duckdb
import pytest

import __spark_entry__ as entry
from derivata.operators import registry, tree
from derivata.plans import queries


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("registry")
    duckdb.sql(f"COPY (SELECT i AS s_suppkey, 'Supplier#' || lpad((i % 200)::VARCHAR, 9, '0') AS s_name FROM range(600) t(i)) TO '{path}/supplier.parquet'")
    duckdb.sql(f"COPY (SELECT i AS c_custkey FROM range(60) t(i)) TO '{path}/customer.parquet'")
    return str(path)


def rows(found):
    return sorted(tuple(map(str, r)) for r in found)


def wanted(folder, name, columns):
    con = duckdb.connect()
    for table in ("supplier", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return rows(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall())


def test_buckets_of_checks_do_not_grow(spark, folder, monkeypatch):
    seen, check = [], registry.check_by_proofs
    monkeypatch.setattr(registry, "check_by_proofs", lambda candidates, assets, nodes, *rest: seen.append(nodes) or check(candidates, assets, nodes, *rest))
    got = entry.queries()["registry_checks"](spark, folder)
    assert rows(got.collect()) == wanted(folder, "registry_checks", got.columns)
    assert max(len(r.prefix) for r in seen[0].collect()) == tree.depth_for(600) == 2


def test_bundles_of_repeated_names(spark, folder):
    got = entry.queries()["bundle_checks"](spark, folder)
    assert rows(got.collect()) == wanted(folder, "bundle_checks", got.columns)
