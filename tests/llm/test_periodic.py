import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from derivata.llm import periodic
from derivata.llm.queries import planted_runs
from derivata.shipping import ship

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(w, least=6, exponent=4):
    out, seen = [], set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i and (i, j) not in seen:
                if not any(s == i and n == j - i + q for s, n, _ in out):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def some_texts():
    r = random.Random(9)
    out = [None, "", " \n\t", "one", "a a a a a a", "a a a a a", "x y " * 40, "ü ß " * 3 + "ü", "w" * 90_000 + " a b a b a b a b end", " ".join(["x"] * 3000), " ".join(f"{i % 7}" for i in range(4000))]
    for _ in range(120):
        k, n = r.choice([1, 2, 3, 40]), r.randint(0, 80)
        out.append(r.choice(" \n") .join(f"w{r.randrange(k)}" for _ in range(n)))
    return out + out[4:8]


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_equal_plain_ones(exponent):
    r = random.Random(exponent)
    for _ in range(300):
        docs = []
        for _ in range(r.randint(0, 4)):
            k, n = r.choice([1, 2, 3, 6]), r.randint(0, 50)
            d = [r.randrange(k) for _ in range(n)]
            if d and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randint(2, 8)
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
            docs.append(d)
        first = np.cumsum([0, *map(len, docs)])
        got = list(zip(*(x.tolist() for x in periodic.runs(np.array(sum(docs, []), np.int64), first, 6, exponent)), strict=True))
        assert got == [(s + first[i], n, q) for i, d in enumerate(docs) for s, n, q in plain_runs(d, 6, exponent)]


def test_leaves_looked_at_stay_in_proportion():
    """The largest child of each node is left out, so that leaves are looked at log n times at most."""
    for w in (np.zeros(4096, np.int64), np.arange(4096) % 3, np.random.default_rng(1).integers(0, 2, 4096)):
        order, levels = periodic.suffixes(w, np.zeros(4096, np.int64), np.full(4096, 4096))
        _, _, _, a, b = periodic.inner_nodes(periodic.common_prefixes(order, levels, np.full(4096, 4096)))
        assert (b - a).sum() <= 4096 * 12


def test_digests_equal_plain_ones(spark):
    ship(spark)
    rows = [(None if i == 12 else i // 2 if i < 6 else i, t, "x", 1) for i, t in enumerate(some_texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int")
    got = [tuple(r) for r in periodic.run_digests(planted_runs(df)).collect()]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=key) == sorted((plain_row(i, t) for i, t, _, _ in rows), key=key)


def test_columns_texts_and_empty_tables(spark):
    ship(spark)
    df = spark.createDataFrame([("k", "a b a b a b a b\tc", "mine", 5)], "`an id` string, `the.text` string, collapsed string, `c0` int")
    row = periodic.periodic_runs(df, "the.text").first()
    assert (row["an id"], row["the.text"], row.c0, row.n_words, row.collapsed) == ("k", "a b a b a b a b\tc", 5, 9, "a b c")
    assert [tuple(r) for r in row.runs] == [(0, 8, 2)]
    assert periodic.run_digests(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, "the.text", exponent=1)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(periodic, "hash_spans", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    buf = np.frombuffer(b"a b a c", np.uint8)
    assert periodic.word_numbers(buf, np.array([0, 2, 4, 6]), np.array([1, 3, 5, 7])).tolist() == [0, 1, 0, 2]
