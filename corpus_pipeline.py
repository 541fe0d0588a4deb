"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Between stages the rows are written to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivata.llm.cluster import cut, drop, written
from derivata.llm.decontaminate import clean_documents
from derivata.llm.quality import quality_filter
from derivata.llm.simhash import simhash_dedup
from derivata.llm.substring_dedup import substring_dedup
from derivata.llm.tokens import bpe_tokens
from derivata.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash-linked ones: the one of the smallest id."""
    ship(spark)
    return simhash_dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated passages; n_chars follows the text."""
    ship(spark)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = substring_dedup(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names["doc_id"], names["text"])
    kept = {c: F.col(n) for c, n in names.items()}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("n_removed") > 0, F.length(names["text"]).cast("bigint")).otherwise(kept["n_chars"])
    return out.select(*[x.alias(c) for c, x in kept.items()])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark text."""
    ship(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and ids. Decoding is checked: a document whose ids do not give its text back fails."""
    ship(spark)
    out = bpe_tokens(docs)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "ids")]
    return out.select(*kept, F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("decoding does not give the text back"))).alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmark_free", benchmark_free),
    ("tokens", tokens),
]

#: SQL can't express links over many steps of fingerprints or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for name, stage in STAGES[:-1]:
        earlier = written()
        docs, path = cut(stage(spark, docs, sf_dir), name)
        # What the stage has left, as its result read it, and the table that it came from.
        drop(spark, *before, *(written() - earlier - {path}))
        before = (path,)
    return STAGES[-1][1](spark, docs, sf_dir)
