"""Exact duplicates by a tree of merged digest runs; DataFrame operations only.

Texts are equal if they are after each ``[\\x20\\x09-\\x0D]+`` has become one blank. A row's key is the SHA-256 of that, with
its byte count and a second, independent hash that verify it: rows go together only if all three agree.

The rows' keys are written once, with the number of the row and of its run: one of ``FAN ** rounds`` runs, by input
partition. A run holds each key once, with the smallest identifier and how many rows there are. In round k the runs whose
numbers differ in digit k only exchange rows, so that each keeps the keys whose own slice has that digit there; what
arrives is merged in the order of keys and stays sorted. After the last round each run has all of one slice of keys, so
no key meets in one place before it has shrunk to ``FAN`` rows, and no run is larger than its share. What has more than
one row goes back down the same way, one answer for each run that has the key, and meets the rows by (run, key): a key
with a third of all rows is dealt over all runs. Texts never leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut, drop

#: Runs that meet in a round.
FAN = 8
KEY = ["digest", "size", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _merged(rows: DataFrame, run: str, keep: Column, n: Column) -> DataFrame:
    """One row for each run and key: the smallest identifier and the number of rows. The least of structures is found by
    sorting, so that what is merged is a sorted run."""
    return rows.groupBy(run, *KEY).agg(F.min(keep).alias("keep"), F.sum(n).alias("n"))


def _slice(rounds: int) -> Column:
    """The slice of a key: a number below FAN ** rounds."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("bigint"), F.lit(FAN**rounds))


def _next(run: str, k: int, rounds: int) -> Column:
    """Where a row goes from a run in round k: digit k of the run's number becomes that of the key's slice."""
    digit = lambda x: F.pmod(F.floor(x / F.lit(FAN**k)), F.lit(FAN)).cast("bigint")
    return F.col(run) + (digit(_slice(rounds)) - digit(F.col(run))) * F.lit(FAN**k)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of ``docs``: id, the columns ``carry``, keep_id, group_size, kept and text_sha256.

    kept is true for one row of each group of equal texts: the one of the smallest id, nulls last, and of repeated rows
    with that id for one of them. keep_id is its id. A null text counts as empty. An empty table gives an empty result."""
    spark = docs.sparkSession
    runs, rounds = int(spark.conf.get("spark.sql.shuffle.partitions")), 1
    while FAN**rounds < runs:
        rounds += 1
    names = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([id_col, *carry]))}
    text = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], normalised(F.col(f"`{text_col}`")).alias("text"))
    rows = text.select(*names.values(), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("check"))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("run0", F.pmod(F.spark_partition_id().cast("bigint"), F.lit(FAN**rounds)))
    rows, rows_path = cut(rows, "digests")
    own = F.col(names[id_col])
    level = _merged(rows, "run0", F.struct(own.isNull().alias("none"), own.alias("id"), F.col("at")), F.lit(1))
    levels, paths = [], []
    for k in range(rounds):
        level, path = cut(level.withColumn(f"run{k + 1}", _next(f"run{k}", k, rounds)), f"run{k}")
        levels.append(level)
        paths.append(path)
        level = _merged(level.repartition(FAN**rounds, f"run{k + 1}"), f"run{k + 1}", F.col("keep"), F.col("n"))
    # Answers, for keys of several rows, back down to every run that has them.
    answers = level.where("n > 1")
    for k in reversed(range(rounds)):
        told = answers.select(f"run{k + 1}", *KEY, F.col("keep").alias("best"), F.col("n").alias("all"))
        answers = levels[k].join(told, [f"run{k + 1}", *KEY]).select(f"run{k}", *KEY, F.col("best").alias("keep"), F.col("all").alias("n"))
    answers, _ = cut(answers, "answers")
    drop(spark, *paths)
    out = rows.join(answers, ["run0", *KEY], "left")
    first = F.col("keep").isNull()
    return out.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        F.when(first, own).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (first | (F.col("at") == F.col("keep.at"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns as they are."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = duplicate_groups(inner, names[id_col], names[text_col], tuple(names.values())).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
