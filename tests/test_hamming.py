import random

import pytest

from derivata.operators import hamming
from derivata.shipping import ship

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(r, h, n):
    for bit in r.sample(range(64), n):
        h ^= 1 << bit
    return h


def plain(queries, registry, k, others):
    ids = {(i, h) for i, h in registry if i is not None and h is not None}
    out = set()
    for q, h in {(q, h) for q, h in queries if q is not None and h is not None}:
        near = sorted(((h ^ x) & MASK).bit_count() * (1 << 40) + i for i, x in ids if not (others and i == q))[:k]
        out |= {(q, d % (1 << 40), d >> 40, n + 1) for n, d in enumerate(near)}
    return out


def clustered(n, seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(max(1, n // 25))]
    return r, [(i, signed(flipped(r, r.choice(centres), r.randint(0, 4)))) for i in range(n)]


@pytest.mark.parametrize("k,others", [(1, False), (10, True)])
def test_equals_brute_force_with_ties_and_copies(spark, k, others):
    ship(spark)
    r, rows = clustered(500, k)
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000, signed(r.getrandbits(64))), (None, 5), (2001, None), (0, rows[0][1])]
    queries = [x for x in rows if x[0] is not None and x[0] % 10 == 0] if others else [(i, signed(flipped(r, rows[i][1] & MASK, i % 9))) for i in range(40)] + [(50, None), (51, signed(r.getrandbits(64)))]
    search = hamming.Search(spark.createDataFrame(queries, "id bigint, hash bigint"), spark.createDataFrame(rows, "id bigint, hash bigint"), k, others)
    assert {tuple(x) for x in search.result().collect()} == plain(queries, rows, k, others)
    assert search.report().first().scanned >= 1
    search.clear()


def test_few_pairs_are_compared_in_clusters(spark):
    ship(spark)
    _, rows = clustered(6000, 3)
    df = spark.createDataFrame(rows, "id bigint, hash bigint")
    search = hamming.Search(df.where("id % 100 = 0"), df, 10, True)
    report = search.report().first()
    assert {tuple(x) for x in search.result().collect()} == plain([x for x in rows if x[0] % 100 == 0], rows, 10, True)
    assert report.n_queries > 50 and report.scanned == 0 and 0 < report.share < 0.05


@pytest.mark.parametrize("n", [2, 1 << 18, 1 << 24, 1 << 40])
def test_parts_cover_all_bits(n):
    parts = hamming._edges(n)
    assert parts[0][0] == 0 and parts[-1][1] == 64 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_empty_sides_and_too_few(spark):
    ship(spark)
    none = spark.createDataFrame([], "id bigint, hash bigint")
    one = spark.createDataFrame([(1, 7)], "id bigint, hash bigint")
    assert hamming.Search(none, one).result().collect() == [] and hamming.Search(one, none).result().collect() == []
    assert hamming.Search(one, one, 3, True).result().collect() == []
    assert [tuple(r) for r in hamming.Search(one, one, 3).result().collect()] == [(1, 1, 0, 1)]
    assert hamming.Search(none, none).report().first().share is None
