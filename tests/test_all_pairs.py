"""Operators on all pairs of two tables, against the same on rows of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from derivata.operators import alignment
from derivata.plans import queries
from derivata.shipping import ship


@pytest.fixture(scope="module")
def sides(spark):
    ship(spark)
    r = np.random.default_rng(5)
    base = r.integers(-(2**63), 2**63, 40)
    # Few values, so that places tie; lengths differ, some candidates are longer than sources, some are empty.
    some = lambda n: [int(base[i]) for i in r.integers(0, 40 if n % 2 else 3, n)]
    c = spark.createDataFrame([(i, some(n)) for i, n in enumerate([7, 7, 1, 2, 4, 9, 0, 6, 3])], "cand bigint, candidate array<bigint>")
    s = spark.createDataFrame([(i, some(n)) for i, n in enumerate([16, 16, 5, 1, 0, 12, 7, 16])], "src bigint, source array<bigint>")
    return c, s


def same(got, want):
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert sorted(got.columns) == sorted(want.columns) and got.count() and key(got) == key(want)


def both(sides):
    return sides[1].crossJoin(sides[0]).where((F.size("candidate") > 0) & (F.size("source") > 0))


def test_align_all(spark, sides):
    for most in (16.0, 30.0):
        same(alignment.align_all(*sides, most=most).drop("n"), alignment.align(both(sides), most=most).drop("candidate", "source"))


@pytest.mark.parametrize("bits_of, one", [(64, alignment.slide), (32, alignment.slide32)])
def test_slide_all(spark, sides, bits_of, one, monkeypatch):
    monkeypatch.setattr(alignment, "DISTANCES", 50)
    want = both(sides).select("cand", "src", one(F.col("candidate"), F.col("source")).alias("best"))
    same(alignment.slide_all(*sides, bits_of=bits_of).drop("n"), want)


def test_coarse_all(spark, sides):
    want = both(sides).select("cand", "src", F.round(alignment.coarse_score(F.col("candidate"), F.col("source")), 12).alias("score"))
    same(alignment.coarse_all(*sides).select("cand", "src", F.round("score", 12).alias("score")), want)


def test_frames_without_a_hash_are_an_error(spark, sides):
    with pytest.raises(Exception, match="a frame has no hash"):
        alignment.slide_all(spark.createDataFrame([(1, [None])], "cand bigint, candidate array<bigint>"), sides[1]).collect()


@pytest.mark.parametrize("name", ["sliding_alignment", "fingerprint_alignment", "fragment_alignment", "frame_matrix"])
def test_queries_on_pairs_deal_stacks(spark, tiny, name):
    plan = queries.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "REPARTITION_BY_NUM" in plan


def test_votes_of_all(spark, monkeypatch):
    from derivata.operators import features

    ship(spark)
    r = np.random.default_rng(3)
    base = r.integers(0, 256, (6, 32), dtype=np.uint8)

    def described(frames):
        rows = [[bytearray(base[i] ^ (r.random(32) < 0.1).astype(np.uint8)) for i in r.integers(0, 6, n)] for n in frames]
        return [([[0.0, 0.0]] * len(f), f) for f in rows]

    kind = "array<struct<points: array<array<double>>, descriptors: array<binary>>>"
    c = spark.createDataFrame([(i, described(n)) for i, n in enumerate([[5, 6], [4], [0, 7], []])], f"cand bigint, candidate {kind}")
    s = spark.createDataFrame([(i, described(n)) for i, n in enumerate([[9, 0, 5], [8, 8], [], [0]])], f"src bigint, source {kind}")
    rows = lambda df: sorted(map(tuple, df.select("cand", "src", "i", "j", "votes").collect()))
    got = rows(features.votes_of_all(c, s))
    assert got and got == rows(features.frame_votes(s.crossJoin(c)))


def test_banded_joins_have_tasks_by_rows(spark, monkeypatch):
    from derivata.operators import retrieval

    monkeypatch.setattr(retrieval, "JOINED", 500)
    rows = spark.range(200).select("id", F.xxhash64("id").alias("hash"))
    pairs = retrieval.banded_pairs(rows, rows)
    # 200 hashes and 20 choices of bands, 500 rows a task.
    assert "8), REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.where("left_id = right_id").count() == 200
