import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from derivata.llm import exact_dedup
from derivata.llm.cluster import sweep

SCHEMA = "doc_id bigint, text string, keep_id string, n int"


def plain(rows):
    groups = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append((doc_id is None, doc_id or 0, i))
    out = []
    for text, of in groups.items():
        first = min(of)
        out += [(None if none else i, None if first[0] else first[1], len(of), hashlib.sha256(text.encode()).hexdigest()) for none, i, _ in of]
    return out, {t: (None if min(of)[0] else min(of)[1]) for t, of in groups.items()}


def rows_of(n):
    r = random.Random(n)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\x0bb", "a\xa0b", " a b", "ü" * 40_000, "ü" * 40_000 + " x"] + [f"t{i}" for i in range(n // 3)]
    rows = [(r.choice([None, *range(n)]), r.choice(texts), "k", 1) for _ in range(n)]
    return rows + rows[:5] + [(i, "hot\ttext", "k", 1) for i in range(n, n + n // 2)]


@pytest.mark.parametrize("n,parts,fan", [(5, 1, 8), (200, 7, 2), (400, 16, 8)])
def test_groups_equal_plain_ones(spark, monkeypatch, n, parts, fan):
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    rows = rows_of(n)
    got = exact_dedup.duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    want, kept = plain(rows)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    stay = [r for r in got if r.kept]
    assert len(stay) == len({r.text_sha256 for r in stay}) == len(kept) and all(r.doc_id == r.keep_id for r in stay)


def test_kept_rows_are_whole(spark):
    rows = [("b.2", "x  y", "old", 3), ("a.1", "x y", None, 4), ("a.1", "x y", None, 4), (None, "x\ny", "z", 5), ("c", None, "q", None)]
    df = spark.createDataFrame(rows, "`an.id` string, `the text` string, keep_id string, kept int")
    got = exact_dedup.exact_dedup(df, "an.id", "the text")
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[4]], key=str)
    assert exact_dedup.exact_dedup(df.limit(0), "an.id", "the text").collect() == []


def test_a_key_moves_one_digit_a_round(spark):
    rounds = 3
    df = spark.range(2000).select((F.col("id") % 512).alias("run0"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    for k in range(rounds):
        df = df.withColumn(f"run{k + 1}", exact_dedup._next(f"run{k}", k, rounds))
    for r in df.withColumn("slice", exact_dedup._slice(rounds)).collect():
        assert r.run3 == r.slice
        for k in range(rounds):
            a, b = r[f"run{k}"], r[f"run{k + 1}"]
            assert a % 8**k == b % 8**k and a // 8 ** (k + 1) == b // 8 ** (k + 1)


def test_no_python_and_sorted_merges(spark):
    df = spark.createDataFrame(rows_of(9), SCHEMA)
    out = exact_dedup.duplicate_groups(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    merged = exact_dedup._merged(df.withColumns({"run": F.col("doc_id") % 4, "digest": F.unhex(F.sha2("text", 256)), "size": F.octet_length("text"), "check": F.xxhash64("text"), "keep": F.struct("doc_id")}).repartition(8, "run"), "run", F.col("keep"), F.lit(1))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 2 and plan.count("Exchange") == 1
    assert sweep(spark) > 0
