import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain

from derivata.llm import cluster, simhash, substring_dedup, words
from derivata.llm.components import components, contract
from derivata.shipping import ship

SCHEMA = "doc_id bigint, text string, n_words string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["ünï", "Größe", "x" * 70]
    passage = [r.choice(vocabulary) for _ in range(120)]
    out = [None, "", "  \n ", "one", " ".join(passage), "\t".join(passage)]
    for i in range(60):
        own = [r.choice(vocabulary) for _ in range(r.randint(0, 200))]
        if i % 3 == 0:
            a = r.randint(0, 60)
            at = r.randint(0, len(own))
            own[at:at] = passage[a : a + r.randint(20, 60)]
        out.append((" " if i % 2 else "\n").join(own))
    out += [out[10]] * 3 + [" ".join(["same"] * 300), " ".join(["a b c"] * 40)]
    return out


@pytest.mark.parametrize("window", [35, 8, 1])
def test_substring_matches_brute_force(spark, texts, window):
    ship(spark)
    rows = [(None if i == 7 else i // 2 * 2 if i < 4 else i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = substring_dedup.substring_digests(df, window=window).collect()
    want = plain.substring(texts, window)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(((i, n, k, plain.sha(t)) for (i, _, _), (n, k, t) in zip(rows, want)), key=key)


def test_substring_keeps_text_and_columns(spark, texts):
    ship(spark)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    for i, (n, removed, kept) in enumerate(plain.substring(texts)):
        assert (got[i].n_words, got[i].n_removed) == (n, removed)
        if removed:
            assert plain.WORD.findall(got[i].text) == kept.split(" ") * bool(kept)
        else:
            assert got[i].text == texts[i]


def test_substring_empty_table(spark):
    ship(spark)
    assert substring_dedup.substring_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_passage_over_many_flushes(spark, monkeypatch):
    ship(spark)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{i} {passage} end{i}", "") for i in range(300)]
    got = substring_dedup.substring_digests(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert {(r.n_words, r.n_removed) for r in got} == {(62, 60)}


def test_long_text_is_split_at_words(monkeypatch):
    monkeypatch.setattr(words, "SEGMENT", 64)
    text = ("aé bc " * 300 + "y" * 500 + " z").encode()
    buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, first = words.spans(buf, off)
    h, f = words.word_hashes(buf, off)
    assert list(f) == list(first) and np.array_equal(h, words.hash_spans(buf, starts, ends))
    assert len(set(h.tolist())) == 4


def test_simhash_matches_brute_force(spark, texts):
    ship(spark)
    rows = [(None if i == 7 else i, t, "x") for i, t in enumerate(texts)] + [(3, "one", "y")]
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [plain.fingerprint(t) for _, t, _ in rows]
    want = plain.components([i for i, _, _ in rows], prints)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, f"{p:016x}", c) for (i, _, _), p, c in zip(rows, prints, want)), key=key)


@pytest.mark.parametrize("levels", [None, 1, 3])
def test_near_roots_finds_all_links(spark, levels):
    """Random fingerprints with chains of near ones, and a dense clump that needs the tree."""
    ship(spark)
    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(1500)]
    for p in prints[:150]:
        for _ in range(6):
            for b in r.sample(range(64), r.randint(1, 3)):
                p ^= 1 << b
            prints.append(p)
    centre = r.getrandbits(64)
    prints += [centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for _ in range(1200)]
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64)
    roots = {x.node: x.root for x in simhash.near_roots(spark.createDataFrame([(int(x),) for x in signed], "fp bigint"), levels)[0].collect()}
    a = np.array(prints, np.uint64)
    u, v = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3, 1))
    node, root = contract(signed[u], signed[v])
    assert len(u) > 3000 and roots == dict(zip(node.tolist(), root.tolist()))


def brute_force(fps):
    x = fps.view(np.uint64)
    u, v = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1))
    return [y.tolist() for y in contract(fps[u], fps[v])]


@pytest.mark.parametrize("half", [0, 1])
def test_search_tree_is_exact(half):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 1, dtype=np.int64)[0]
    flips = np.array([sum(1 << int(b) for b in r.choice(40, 4, replace=False)) for _ in range(2500)], np.int64)
    fps = np.unique(base ^ flips)
    links = simhash._Links()
    met = simhash.search(np.zeros(len(fps), np.int64), fps, np.full(len(fps), 3, np.int8), np.ones(len(fps), bool), half, 0, links)
    assert len(fps) <= met < len(fps) ** 2 / 2
    assert [y.tolist() for y in links.shortened()] == brute_force(fps)


def test_every_shard_goes_through_the_tree():
    """On the documents of the small tables: few of the pairs of a shard meet in a leaf, and no link is lost."""
    texts = pa.parquet.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0)
    fps = np.unique(simhash.fingerprints(*words.text_buffers(texts)).view(np.int64))
    links, met, pairs = simhash._Links(), 0, 0
    for batch in simhash._visits(0)([pa.RecordBatch.from_arrays([pa.array(fps)], names=["fp"])]):
        shard, fp, left, home, half = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        met += simhash.search(shard, fp, left, home, int(half[0]), 0, links)
        n = np.bincount(shard[home], minlength=2 * 5**8)
        pairs += int(n[shard].sum())
    own = 2 * len(fps)  # every fingerprint meets itself in each half
    assert 0 <= met - own < 0.3 * (pairs - own)
    assert [y.tolist() for y in links.shortened()] == brute_force(fps)


def test_fingerprints_of_long_texts_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    want = [plain.fingerprint(t) for t in (text, "", "a b", text[:-3])]
    monkeypatch.setattr(simhash, "SHINGLES", 700)
    got = simhash.fingerprints(*words.text_buffers(pa.array([text, "", "a b", text[:-3]])))
    assert got.tolist() == want


def thue_morse(letters, n=10):
    """Words that 64-bit polynomial hashes of any base take for equal."""
    word, swapped = letters, letters[::-1]
    for _ in range(n - 1):
        word, swapped = word + swapped, swapped + word
    return word, swapped


@pytest.mark.parametrize("n", [10, 12])
def test_words_of_equal_hashes_are_told_apart(spark, n):
    ship(spark)
    a, b = thue_morse("ab", n)
    both = np.frombuffer((a + " " + b).encode(), np.uint8)
    cut = np.array([0, len(a) + 1]), np.array([len(a), len(both)])
    assert len(set(words.hash_spans(both, *cut).tolist())) == 1
    shared = " ".join(f"s{i}" for i in range(34))
    rows = [(1, f"{shared} {a}", ""), (2, f"{shared} {b}", ""), (3, f"{shared} {a} x", "")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 35, 2: 0, 3: 35}


def test_substring_takes_ids_of_any_type_and_odd_names(spark):
    ship(spark)
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([("a", text, 1), ("b", f"x {text}", 2), (None, "y", 3)], "id string, `my.text` string, found int")
    got = {r.id: (r.n_removed, r.found) for r in substring_dedup.substring_dedup(df, "id", "my.text").collect()}
    assert got == {"a": (40, 1), "b": (40, 2), None: (0, 3)}


def test_simhash_dedup_keeps_one_of_each(spark):
    ship(spark)
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(4, text, "a"), (2, text, "b"), (2, text, "b"), (9, "other words here entirely", "c"), (None, text, "d"), (7, None, "e"), (8, "", "f")]
    got = simhash.simhash_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == [2, 7, 9]
    assert simhash.simhash_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sweep_deletes_what_is_left(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(cluster, "_written", [])
    got = simhash.simhash_components(spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], SCHEMA))
    assert got.count() == 2
    paths = list(cluster._written)
    assert paths and cluster.sweep(spark) == len(paths) and cluster._written == []
    assert not any(Path(p.removeprefix("file://")).exists() for p in paths)


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(5, 5), (7, 8), (100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint"))[0].collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint"))[0].collect() == []
