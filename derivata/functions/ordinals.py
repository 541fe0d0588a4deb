"""Ordinal numbers and running aggregates over a distributed order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back; a folder of its own where that is unset and all is local."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if found := df.sparkSession.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(found)
        elif context.master.startswith("local"):
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="derivata-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint()


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with number = 1, 2, ... by an order (equal rows in any): ranks inside range partitions, and one small sum
    over these. The dealt rows are checkpointed, as the bounds of ranges come from a sample and must be the same twice."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inside.join(F.broadcast(starts), "_part").withColumn("number", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _by_ranges(rows: DataFrame, order: str, descending: bool) -> DataFrame:
    """``rows`` with _range: the number of the range of a column that a row is in, in its order; ranges have about equal
    shares of all rows, and equal values are in one. They are written, as their bounds come from a sample."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.desc(order) if descending else F.asc(order)
    return checkpointed(rows.repartitionByRange(n, by).withColumn("_range", F.spark_partition_id()))


def running_sums(rows: DataFrame, by: list[str], order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with each of ``columns`` summed up to and including its place by ``order`` (numbers; ties together) in
    its group.

    Rows are dealt to ranges of the order; inside a range a window sums, and one small table of range totals gives what
    comes before. So no group is summed by one task."""
    dealt = _by_ranges(rows, order, descending)
    inside = W.partitionBy(*by, "_range").orderBy(F.desc(order) if descending else F.col(order)).rangeBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    ahead = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    summed = dealt.withColumns({c: F.sum(c).over(inside) for c in columns}).join(ahead, [*by, "_range"])
    return summed.withColumns({c: F.col(c) + F.col(f"_{c}") for c in columns}).drop("_range", *[f"_{c}" for c in columns])


def greatest_before(rows: DataFrame, by: list[str], order: str, column: str, name: str) -> DataFrame:
    """``rows`` with the greatest value of ``column`` strictly before each place by ``order`` (distinct numbers in a group)
    in its group; null for the first. By ranges, as :func:`running_sums`."""
    dealt = _by_ranges(rows, order, False)
    inside = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_range").agg(F.max(column).alias("_m")).select(*by, "_range", F.max("_m").over(before).alias("_m"))
    return dealt.withColumn(name, F.max(column).over(inside)).join(totals, [*by, "_range"]).withColumn(name, F.greatest(name, "_m")).drop("_range", "_m")
