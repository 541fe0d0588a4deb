import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from derivata.llm import merkle
from derivata.llm.cluster import sweep
from derivata.shipping import ship

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes, fanout=8):
    """The root, and of each node the (run, place) on its way up."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for i, k in enumerate(at):
            run = now[k // fanout * fanout : k // fanout * fanout + fanout]
            paths[i].append((run, k % fanout))
        now = [h(*now[i : i + fanout]) for i in range(0, len(now), fanout)]
        at = [k // fanout for k in at]
    return now[0] if now else None, paths


def plain_rows(rows, fanout=8):
    by, out = {}, []
    for row in rows:
        by.setdefault(row[2], []).append(row)
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = []
    for k in order:
        of = sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees.append((of, *plain_tree([plain_leaf(r, r[1]) for r in of], fanout)))
    root, over = plain_tree([t[1] for t in trees], fanout)
    for (of, subroot, paths), above in zip(trees, over, strict=True):
        for row, path in zip(of, paths, strict=True):
            leaf, text = plain_leaf(row, row[1]), row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = plain_leaf(row, text)
            for run, i in path + above:
                now = h(*run[:i], now, *run[i + 1 :])
            out.append((row[0], leaf, subroot, root, h(*(x for run, i in path + above for x in run[:i] + run[i + 1 :])), now, now == root))
    return out


def some_rows(n, langs):
    r = random.Random(n)
    text = lambda: r.choice([None, "", "Ünï Code", "plain lower", "X" * r.randint(0, 300), "Mixed Case\n"])
    return [(i * 7 - 20, text(), r.choice(langs), r.choice([None, "", "web"]), r.choice([None, 3])) for i in range(n)]


def key(row):
    return [(x is None, str(x)) for x in row]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en"]), (9, ["en", None]), (700, ["en", "en", "en", "de", "", None, "é"])])
def test_digests_equal_plain_ones(spark, n, langs):
    ship(spark)
    rows = some_rows(n, langs)
    assert sorted(map(tuple, merkle.tamper_digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=key) == sorted(plain_rows(rows), key=key)


@pytest.mark.parametrize("fanout,levels", [(2, 1), (2, 3), (3, 2)])
def test_any_superblock_gives_the_same_tree(spark, fanout, levels):
    ship(spark)
    rows = some_rows(70, ["a", "a", "b", "c", "d", "e"])
    leaves = spark.createDataFrame([(r[0], r[2], plain_leaf(r, r[1])) for r in rows], "i bigint, k string, leaf string").repartition(3)
    got = merkle.merkle_tree(leaves, "k", ["i"], "leaf", fanout, levels)
    got = got.withColumn("now", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("proof", F.sha2(merkle.siblings(F.col("path")), 256)).collect()
    want = {r[0]: r for r in plain_rows(rows, fanout)}
    assert len(got) == 70 and {(r.subroot, r.root, r.proof) for r in got} == {x[2:5] for x in want.values()}
    assert all(r.now == r.root == want[r.i][3] and r.subroot == want[r.i][2] for r in got)


def test_ties_nulls_names_and_empty_tables(spark):
    ship(spark)
    rows = [(None, "A", None, "s", 1)] * 9 + [(5, "B", None, "s", 1)] * 3 + [(5, "b", "x", None, None)]
    got = sorted(map(tuple, merkle.tamper_digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=key)
    assert got == sorted(plain_rows(rows), key=key)
    odd = spark.createDataFrame([("p.1", "l", "ab", 3)], "`an.id` string, node string, leaf string, path int")
    assert [tuple(r) for r in merkle.merkle_tree(odd, "node", ["an.id"], "leaf").collect()] == [("p.1", "l", "ab", 0, "ab", "ab", [])]
    assert merkle.tamper_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_manifest_tells_which_rows_changed(spark):
    ship(spark)
    rows = some_rows(60, ["a", "b"])
    docs = spark.createDataFrame(rows, SCHEMA)
    manifest = merkle.merkle_manifest(docs)
    now = docs.withColumn("n_chars", F.when(F.col("doc_id") == 8, 99).otherwise(F.col("n_chars"))).select("doc_id", merkle.leaf_digest(*map(F.col, merkle.FIELDS)).alias("now"))
    changed = manifest.join(now, "doc_id").where(merkle.folded(F.col("now"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in changed.collect()] == [8]
    assert sweep(spark) > 0
