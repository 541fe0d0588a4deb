"""Identity-level partitions: splits, inheritance, leakage and coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_by_identity(assets: DataFrame, calibration: float = 0.5, by: str = "role", key: str = "identity") -> DataFrame:
    """(identity, role, partition): of each role's identities in order, the first share (one at least, and one left for
    evaluation where there are two) calibrates. Whole identities go one way. A list of identities has few rows."""
    ids = assets.groupBy(by, key).agg(F.count("*").alias("n_assets"))
    order = W.partitionBy(by).orderBy(key)
    n, at = F.count("*").over(W.partitionBy(by)), F.row_number().over(order)
    first = F.greatest(F.lit(1), F.floor(n * F.lit(calibration)))
    return ids.select(by, key, "n_assets", F.when(at <= F.when(n > 1, F.least(first, n - 1)).otherwise(1), "calibration").otherwise("evaluation").alias("partition"))


def inherit(candidates: DataFrame, partitions: DataFrame) -> DataFrame:
    """Candidates with their partition: a derivative has its parent's, a negative its own, otherwise unknown."""
    parent = partitions.select(F.col("id").alias("expected_parent"), F.col("partition").alias("_p"))
    own = partitions.select(F.col("id").alias("negative_id"), F.col("partition").alias("_n"))
    return candidates.join(parent, "expected_parent", "left").join(own, "negative_id", "left").select(*candidates.columns, F.coalesce("_p", "_n", F.lit("unknown")).alias("partition"))


def leaks(partition: DataFrame) -> DataFrame:
    """(rule, key, n): ids listed twice, and identity groups or components in several partitions."""
    twice = partition.groupBy(F.col("id").cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), "key", "n")
    spread = lambda column, rule: partition.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key")).agg(F.countDistinct("partition").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key", "n")
    return twice.union(spread("identity_group", "group_spans_partitions")).union(spread("component_id", "component_spans_partitions"))


def coverage(expected: DataFrame, found: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(key, problem) of rows that are missing, not expected, or labelled otherwise."""
    a = expected.select(key, *[F.col(c).alias(f"e_{c}") for c in labels], F.lit(True).alias("_e"))
    b = found.select(key, *[F.col(c).alias(f"f_{c}") for c in labels], F.lit(True).alias("_f"))
    both = a.join(b, key, "full_outer")
    same = F.lit(True)
    for c in labels:
        same = same & F.col(f"e_{c}").eqNullSafe(F.col(f"f_{c}"))
    problem = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(~same, "label_mismatch")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids only here, only there, and whether the sets are equal."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    out = x.join(y, key, "full_outer").agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"))
    return out.withColumn("equal", F.col("only_first") + F.col("only_second") == 0)


def representative_subset(rows: DataFrame, length: float = 5, transforms: tuple[str, ...] = ("trim", "crop25", "speed125")) -> DataFrame:
    """Of each partition, the rows of one length that are of the first source identity under a few transforms, or of the
    first negative one: what a reproducibility pass repeats."""
    first = rows.groupBy("partition", "role").agg(F.min("identity").alias("identity"))
    chosen = (F.col("role") == "negative") | F.col("transform").isin(*transforms)
    return rows.where((F.col("length_s") == length) & chosen).join(first, ["partition", "role", "identity"], "left_semi")
