"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import oracle
from .chat import chat_digests, format_chat
from .cluster import cut
from .decontaminate import decontamination_digests
from .exact_dedup import duplicate_groups
from .html import extract_html
from .licenses import license_scan
from .merkle import tamper_digests
from .periodic import run_digests
from .quality import quality_rules
from .simhash import simhash_components
from .substring_dedup import substring_digests
from .tokenfile import token_file_digests
from .tokens import bpe_digests
from .url_filter import url_filter


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: What the list of the query has besides what follows from the pages: (kind, key, action, day).
URL_LIST = (
    ("domain", "spam-farm.example.org", "add", "2024-02-10"),
    ("domain", "spam-farm.example.org", "remove", "2024-06-01"),
    ("domain", "spam-farm.example.org", "add", "2024-09-15"),
    ("domain", "cheap-pills.example.com", "add", "2024-03-01"),
    ("domain", "tionsh.example.net", "add", "2024-05-20"),
    ("domain", "tionsh.example.net", "remove", "2024-08-20"),
    ("prefix", "thther.example.org/en", "add", "2024-04-01"),
    ("prefix", "blog.ththan.example.net", "add", "2024-07-01"),
)
#: Captures of a page, and the least part of a page's address that the list may name.
CAPTURES, HOST_AND_SEGMENT = 3, r"^[a-z]+://([^/?#]+/[^/?#]+)"


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures of every page against the list of their fetch times.

    Pages have no fetch times, so page_id gives days of 2024. The list has, besides its own entries, one for each host
    and first path segment that a page of page_id divisible by 5 has, listed on a day that its least page_id gives, and
    taken off 60 days later where that id is even."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    at = lambda days: F.expr(f"timestampadd(DAY, CAST(({days}) % 366 AS INT), TIMESTAMP'2024-01-01 00:00:00')")
    captures = pages.withColumn("capture", F.explode(F.array(*map(F.lit, range(CAPTURES))))).withColumn("fetched_at", at("page_id + capture * 131"))
    keys = pages.where("page_id % 5 = 0").select(F.regexp_extract(F.lower("url"), HOST_AND_SEGMENT, 1).alias("key"), "page_id").where("key <> ''").groupBy("key").agg(F.min("page_id").alias("p"))
    entry = lambda action, day: F.struct(F.lit("prefix").alias("kind"), F.col("key"), F.lit(action).alias("action"), day.alias("day"))
    dated = keys.select(entry("add", at("p * 7")).alias("e")).union(keys.where("p % 2 = 0").select(entry("remove", at("p * 7") + F.expr("INTERVAL 60 DAYS")).alias("e"))).select("e.*")
    values = ", ".join(f"('{kind}', '{key}', '{action}', TIMESTAMP'{day} 00:00:00')" for kind, key, action, day in URL_LIST)
    entries = spark.sql(f"SELECT * FROM VALUES {values} AS t(kind, key, action, day)").unionByName(dated)
    day = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)
    return url_filter(captures, entries).select("page_id", "url", day("fetched_at", "fetched_on"), "blocked", "list_kind", "list_key", day("listed_since", "listed_since"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -1, whose texts look like control strings: written, and read back."""
    odd = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    written, _ = cut(format_chat(table.unionByName(more)), "chat")
    return chat_digests(written)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _planted(ids: pd.Series, texts: pd.Series) -> pd.Series:
    """Texts of one period from word g % n on, where g is a tenth of the CRC-32 of the id's digits."""

    def one(doc_id, text):
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        if not words:
            return text
        g, n = zlib.crc32(doc_id.encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join(words[:a] + [words[a + i % p] for i in range(n - a)])

    return pd.Series(map(one, ids, texts), dtype=object)


def planted_runs(docs: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text); one text of ten, by the CRC-32 of its id, turns periodic somewhere."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    planted = F.pandas_udf(_planted, "string")(F.col("doc_id").cast("string"), F.when(chosen, F.col("text")))
    return docs.select("doc_id", F.when(chosen, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _shipped(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in (op1_substring_dedup, op2_quality_rules, op3_token_files, op4_license_scan, op5_html_extraction, op6_chat_format, op7_bpe, op8_decontamination, op9_url_filter, op10_simhash_near_dedup, op11_exact_dedup, op12_periodic_runs, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": oracle.OP1,
        "op2_quality_rules": oracle.OP2,
        "op6_chat_format": oracle.OP6,
        "op8_decontamination": oracle.OP8,
        "op9_url_filter": oracle.op9(URL_LIST, CAPTURES, HOST_AND_SEGMENT),
        "op11_exact_dedup": oracle.OP11,
        "op12_periodic_runs": oracle.OP12,
        "op13_merkle_manifest": oracle.op13(),
    }
