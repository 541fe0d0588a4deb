"""The pipeline's stages one by one against brute force, and as a whole."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain

import corpus_pipeline
from derivata.llm import bpe, oracle, queries
from derivata.llm.cluster import cut
from derivata.shipping import ship


@pytest.fixture(scope="module")
def stages(spark, tiny):
    """(name, rows before, rows after) of each stage."""
    ship(spark)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, tiny)
        assert name == "tokens" or made.columns == columns
        after, _ = cut(made, name)
        out[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()})
        docs = after
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "benchmark_free", "tokens"]


def test_quality_stage(stages):
    before, after = stages["quality"]
    assert all(not plain.quality(r.text)[-1] for r in after.values()) and all(after[i] == before[i] for i in after)
    assert 0.6 * len(before) < len(after) < len(before)


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]
    ids = sorted(before)
    roots = plain.components(ids, [plain.fingerprint(before[i].text) for i in ids])
    assert sorted(after) == sorted(set(roots)) and all(after[i] == before[i] for i in after)


def test_repeats_stage(stages):
    before, after = stages["repeats"]
    ids = sorted(before)
    for i, (n, removed, kept) in zip(ids, plain.substring([before[i].text for i in ids])):
        assert " ".join(plain.WORD.findall(after[i].text)) == (kept if removed else " ".join(plain.WORD.findall(before[i].text)))
        assert after[i].n_chars == len(after[i].text) if removed else after[i] == before[i]


def test_benchmark_stage(spark, tiny, stages):
    before, after = stages["benchmark_free"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    ids = sorted(before)
    assert sorted(after) == [i for i, x in zip(ids, plain.leaks([before[i].text for i in ids], items)) if not x[-1]]


def test_tokens_stage(stages):
    before, after = stages["tokens"]
    library = bpe.library(bpe.default_path())
    assert all(after[i].ids == library.encode(before[i].text, add_special_tokens=False).ids and after[i].n_tokens == len(after[i].ids) for i in before)


def test_stages_take_empty_tables_clashing_names_and_repeated_rows(spark, tiny):
    ship(spark)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(40)
    for name in ("n_words", "n_removed", "kept", "my.col", "c0", "contaminated"):
        docs = docs.withColumn(name, corpus_pipeline.F.lit("own"))
    docs, _ = cut(docs, "docs")
    for rows in (docs.where("false"), docs.union(docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, tiny)
            assert out.columns[: len(docs.columns)] == docs.columns and (name == "tokens" or len(out.columns) == len(docs.columns))
            got = out.collect()
            assert all(r["my.col"] == r["n_words"] == r["kept"] == "own" for r in got) and (name not in ("repeats", "tokens") or len(got) == rows.count())


def test_run_gives_what_the_stages_give(spark, tiny, stages):
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, tiny).collect()} == stages["tokens"][1]


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] and set(queries.oracle_sql()) <= set(names)
    assert all(isinstance(v, str) for v in queries.oracle_sql().values()) and oracle.OP1
