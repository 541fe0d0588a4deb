"""Queries that have to read and search whole tables, against SQL without any cut."""

import duckdb
import pytest

import __spark_entry__ as registry
from derivata.plans import fixtures as fx

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small():
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def same(spark, small, name, sql):
    got, want = registry.queries()[name](spark, SMALL), small.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.fetchall()
    assert rows and sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(rows)


def test_leakage_checks_reads_all_documents(spark, small):
    p = "WITH p AS (SELECT doc_id // 2 AS id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS part, source AS g, lang AS c FROM documents)"
    spread = lambda c, rule: f"SELECT '{rule}', {c}, count(DISTINCT part) FROM p GROUP BY {c} HAVING count(DISTINCT part) > 1"
    same(spark, small, "leakage_checks", f"{p} SELECT 'duplicate_id' AS rule, id::VARCHAR AS key, count(*) AS n FROM p GROUP BY id HAVING count(*) > 1 UNION ALL {spread('g', 'group_spans_partitions')} UNION ALL {spread('c', 'component_spans_partitions')}")


TOP = f"""WITH {fx.HASHES}, p AS (SELECT a.id AS candidate, b.id AS parent, bit_count(xor(a.hash, b.hash))::BIGINT AS distance FROM hashes a, hashes b WHERE a.id % 100 = 0 AND b.id <> a.id),
top AS (SELECT candidate, parent, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY distance, parent) AS rank FROM p) WHERE rank <= 10)"""
SCORES = "greatest(0, 32 - a.distance)::BIGINT", "(greatest(0, 32 - a.distance) - greatest(0, 32 - b.distance))::BIGINT"
ASSETS = "WITH assets AS (SELECT doc_id AS id, sha256(text) AS sha256 FROM documents)"
SEARCHES = {
    "retrieval_top_k": f"{TOP} SELECT * FROM top",
    "retrieval_margin": f"{TOP} SELECT a.candidate, a.parent AS top_parent, {SCORES[0]} AS score_32nds, {SCORES[1]} AS margin_32nds, CASE WHEN {SCORES[1]} / 32.0 < 0.08 THEN 'AMBIGUOUS' ELSE 'ranked' END AS disposition FROM top a JOIN top b ON a.candidate = b.candidate AND a.rank = 1 AND b.rank = 2",
    "retrieval_recall": f"{TOP}, t AS (SELECT a.id AS candidate, min(b.id) AS parent FROM hashes a JOIN hashes b ON a.label = b.label AND a.id % 100 = 0 AND a.id <> b.id GROUP BY a.id), h AS (SELECT t.candidate, rank FROM t LEFT JOIN top USING (candidate, parent)) SELECT k::BIGINT AS k, count(*) FILTER (WHERE rank <= k) AS hits, count(*) AS n FROM h, (VALUES (1), (5), (10)) ks(k) GROUP BY k",
    "target_sets": f"{TOP}, t AS (SELECT candidate, parent FROM top WHERE rank <= 3 UNION SELECT id, 1 FROM hashes WHERE id % 100 = 0) SELECT candidate, count(*) AS n_targets FROM t GROUP BY candidate",
    "exact_join": f"{ASSETS} SELECT c.id AS candidate, count(DISTINCT a.id) AS n_parents, min(a.id) AS first_parent FROM assets c JOIN assets a ON a.sha256 = c.sha256 AND c.id % 100 = 0 AND a.id <> c.id GROUP BY c.id",
    "anti_join": f"{ASSETS} SELECT id FROM assets c WHERE id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.id <> c.id AND a.sha256 = c.sha256)",
}


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_leave_out_the_query_only(spark, small, name):
    same(spark, small, name, SEARCHES[name])
