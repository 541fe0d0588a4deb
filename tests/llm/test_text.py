import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import hashlib

import plain

from derivata.llm import bpe, decontaminate, quality, tokenfile, tokens
from derivata.shipping import ship

SCHEMA = "doc_id bigint, text string, n_tokens string, kept string"
PATH = bpe.default_path()


@pytest.fixture(scope="module")
def odd():
    r = random.Random(2)
    alphabet = "ab'stredlvm \n\t .,!é中1２٣̀  x<|>🙂"
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
    return [*out, None, "", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>  c", "x" * 5000, "  a", "a  ", "don't 'sabc ''s 's 'll'd I'VE", "the theaea thinging " * 50, "a\r\nb c"]


@pytest.mark.parametrize("kind", [bpe.Speculator, bpe.Library])
def test_ids_equal_the_library(kind, odd):
    words, want = kind(PATH), [e.ids for e in bpe.library(PATH).encode_batch([t or "" for t in odd], add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        ids, cuts = words.encode(*bpe.text_buffers(pa.array(odd, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want


def test_forgetting_changes_nothing(odd, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_BYTES", 10)
    words = bpe.Speculator(PATH)
    a = words.encode(*bpe.text_buffers(pa.array(odd, pa.string())))
    b = words.encode(*bpe.text_buffers(pa.array(odd, pa.string())))
    assert np.array_equal(a[0], b[0]) and words.failed and words.failed < words.proposed


def test_index_numbers_hashes():
    index, r = bpe._Index(), np.random.default_rng(0)
    seen = {}
    for _ in range(30):
        new = np.unique(r.integers(0, 1 << 62, 9000, dtype=np.uint64))
        new = new[index.find(new) < 0]
        numbers = np.arange(len(seen), len(seen) + len(new))
        index.add(new, numbers)
        seen |= dict(zip(new.tolist(), numbers.tolist()))
    keys = np.array(sorted(seen), np.uint64)
    assert index.find(keys).tolist() == [seen[k] for k in keys.tolist()]


@pytest.mark.parametrize("kind", [bpe.Speculator, bpe.Library])
@pytest.mark.parametrize("n", [9, 11])
def test_words_of_equal_hashes_are_told_apart(kind, n):
    """Words that 64-bit polynomial hashes of any base take for equal: in one batch, and one after the other."""
    a, b = "ab", "ba"
    for _ in range(n):
        a, b = a + b, b + a
    words, want = kind(PATH), {t: bpe.library(PATH).encode(t, add_special_tokens=False).ids for t in (a, b)}
    for batch in ([a, b, a], [b], [a, b]):
        ids, cuts = words.encode(*bpe.text_buffers(pa.array(batch)))
        assert [ids[x:y].tolist() for x, y in zip(cuts[:-1], cuts[1:])] == [want[t] for t in batch]


def test_long_texts_go_in_parts(odd, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    text = " ".join(t for t in odd if t)
    words, want = bpe.Speculator(PATH), bpe.library(PATH).encode(text, add_special_tokens=False).ids
    ids, cuts = words.encode(*bpe.text_buffers(pa.array(["", text, None, "x y"])))
    assert len(words.splitter.parts(*bpe.text_buffers(pa.array([text])))) > 20
    assert ids[cuts[1] : cuts[2]].tolist() == want and np.diff(cuts).tolist() == [0, len(want), 0, 2]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_other_kinds_of_tokenizers_are_refused(tmp_path, change):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f) | change
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="supported"):
        bpe.Splitter(str(tmp_path / "t.json"))


def test_pair_compatibility_equals_exact_merging():
    words, r = bpe.Speculator(PATH), random.Random(4)
    sound = [t for t in r.sample(range(256, 50256), 400) if words.exact(words.spelt[t]) == [t]]
    pairs = [(r.choice(sound), r.choice(sound)) for _ in range(3000)]
    a, b = (np.array(x) for x in zip(*pairs))
    assert words.compatible(a, b).tolist() == [words.exact(words.spelt[x] + words.spelt[y]) == [x, y] for x, y in pairs]


def test_bpe_round_trip(spark, odd):
    ship(spark)
    df = spark.createDataFrame([(i, t, "old", "k") for i, t in enumerate(odd)], SCHEMA)
    rows = tokens.bpe_tokens(df).collect()
    assert all(r.decoded == (odd[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.kept == "k" for r in rows)
    one = {r.doc_id: r for r in tokens.bpe_digests(df).collect()}
    for r in rows:
        assert (one[r.doc_id].ids_sha256, one[r.doc_id].decoded_sha256) == (hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), plain.sha(odd[r.doc_id] or ""))
    assert tokens.bpe_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_packing_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = tokenfile.pack(x)
        assert len(control) == -(-n // 4) and np.array_equal(tokenfile.unpack(control, data, n), x)


def test_token_files(spark, odd, tmp_path, monkeypatch):
    ship(spark)
    rows = [(i * 7 % 419, t, "", "") for i, t in enumerate(odd)]
    folder = f"file://{tmp_path}/t"
    tokenfile.write_tokens(spark.createDataFrame(rows, SCHEMA), folder)
    got = tokenfile.read_tokens(spark, folder).orderBy("start").collect()
    want = {i: bpe.library(PATH).encode(t or "", add_special_tokens=False).ids + [2] for i, t, _, _ in rows}
    assert [r.doc_id for r in got] == sorted(want) and all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    digests = {r.doc_id: r.ids_crc32 for r in tokenfile.read_tokens(spark, folder, digests=True).collect()}
    assert digests == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want.items()}
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    counts = np.bincount([x for ids in want.values() for x in ids])
    assert [r.id for r in ranks] == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))


def test_token_files_of_ties_nulls_and_nothing(spark):
    ship(spark)
    rows = [(5, "b", "", ""), (5, "b", "", ""), (5, "a longer one", "", ""), (None, "null id", "", ""), (1, None, "", "")]
    got = tokenfile.token_file_digests(spark.createDataFrame(rows, SCHEMA)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5] and sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    assert tokenfile.token_file_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_quality_measures_and_verdicts(spark):
    good = " ".join(f"the house{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(30))
    texts = [None, "", " \n\t", "one two", "a b c a b c", "x\x0by\x0cz\rq", good, good + "\n...\n...", "### *** $$$ " * 40, good.replace(" ", "# "), " ".join(["word"] * 60), "q " * 49 + "q", "ünï → ok\nünï → ok\n  ünï → ok"]
    df = spark.createDataFrame([(i, t, "", "shadow") for i, t in enumerate(texts)], SCHEMA)
    for r in quality.quality_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (r.doc_id == 6)  # the next one has lines of dots
    kept = quality.quality_filter(df).collect()
    assert [r.doc_id for r in kept] == [6] and kept[0].kept == "shadow" and kept[0].text == good
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_quality_with_odd_names_and_repeated_rows(spark):
    names = ["__t", "__w", "__l", "__x", "my.text", "a b", "kept", "n_words", "c0", "c1"]
    df = spark.createDataFrame([(1, 2, 3, 4, "one two", 5, 6, 7, 8, 9)] * 2, names)
    got = quality.quality_rules(df, "my.text").collect()
    assert len(got) == 2 and [got[0][c] for c in ("__t", "__x", "my.text", "a b", "c0", "c1", "n_words", "kept")] == [1, 4, "one two", 5, 8, 9, 2, False]
    assert quality.quality_filter(df, "my.text").columns == names


def test_quality_on_long_repeats(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdef") for _ in range(20_000)), " ".join(f"w{i % 7}" for i in range(5000))]
    got = quality.quality_rules(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    assert [g.n_repeat_words for g in got] == [plain.quality(t)[4] for t in texts]


@pytest.mark.parametrize("size", [100_000, 12])
def test_decontamination_matches_brute_force(spark, monkeypatch, size):
    ship(spark)
    monkeypatch.setattr(decontaminate, "PART_WORDS", size)
    monkeypatch.setattr(decontaminate, "RUN_WORDS", 5 if size < 100 else 5000)
    q = "What is the 3rd largest city of the northern region by area or people?"
    items = [(1, q), (2, "Paris, Texas"), (3, None), (4, "!!!"), (10, q + " Then tell me why, in ten words or more please."), (None, "no id here"), (5, "Paris, Texas")]
    texts = [None, "", "nothing here", f"So: {q.upper()} -- yes", "paris\ntexas paris texas", "parís texas", "xparis texas", "NO ID HERE!", q.replace(" ", "  ")[:-30], "ünder Paris-Texas ünder", " ".join(q.split()[2:]) + " what is the"]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontamination_digests(docs, bench).collect()}
    assert [got[i] for i in range(len(texts))] == plain.leaks(texts, items)
    full = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert [texts[9][s.start : s.end] for s in full[9].spans] == ["Paris-Texas"] and full[9]["items"] == ["2", "5"]
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [i for i in range(len(texts)) if not got[i][-1]]
    assert decontaminate.decontamination_digests(docs.where(F.lit(False)), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontamination_digests(docs, bench.where(F.lit(False))).collect())
    twice = decontaminate.decontamination_digests(docs.union(docs), bench).collect()
    assert sorted(map(str, twice)) == sorted(map(str, decontaminate.decontamination_digests(docs, bench).collect() * 2))


def test_one_automaton_scans_the_text_once(spark):
    ship(spark)
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{k}" for k in range(40))) for i in range(300)], "item_id bigint, text string")
    docs = spark.createDataFrame([(7, "so b7x3 b7x4 and b9x0 " + " ".join(f"b9x{k}" for k in range(12)))], "doc_id bigint, text string")
    found = decontaminate.decontamination_digests(docs, bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(r.n_hit, r.n_items) for r in found.collect()] == [(12, 1)]


def test_decontamination_of_words_of_equal_hashes(spark):
    ship(spark)
    a, b = "ab", "ba"
    for _ in range(10):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"x {b} y")], "doc_id bigint, text string")
    for item, want in ((a, [True, False, False]), (f"{b} {a}", [False] * 3), (b, [False, True, True])):
        bench = spark.createDataFrame([(1, item), (2, "other words")], "item_id bigint, text string")
        assert [r.contaminated for r in decontaminate.decontamination_digests(docs, bench).orderBy("doc_id").collect()] == want
