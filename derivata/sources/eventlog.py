"""Spark's own event log as a table: what each task used, by stage and by job group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names of the event log's fields.
_SCHEMA = """Event string, `Stage ID` bigint, `Stage IDs` array<bigint>, Properties map<string,string>,
`Task Info` struct<`Task ID`: bigint, `Launch Time`: bigint, `Finish Time`: bigint, Failed: boolean>,
`Task Metrics` struct<`Executor CPU Time`: bigint, `Executor Run Time`: bigint, `JVM GC Time`: bigint, `Peak Execution Memory`: bigint, `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint,
  `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>, `Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint, `Local Bytes Read`: bigint>, `Input Metrics`: struct<`Bytes Read`: bigint, `Records Read`: bigint>>"""
MEASURES = ("run_s", "cpu_s", "gc_s", "spilled_bytes", "shuffle_written_bytes", "shuffle_read_bytes", "input_bytes", "input_rows")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The log's events; a line that is still being written is left out."""
    return spark.read.schema(_SCHEMA).json(path, mode="DROPMALFORMED")


def task_usage(events: DataFrame) -> DataFrame:
    """(stage, task, failed, run_s, cpu_s, gc_s, peak_bytes, spilled_bytes, shuffle_written_bytes, shuffle_read_bytes,
    input_bytes, input_rows) of each task that ended; 0 for what it did not report."""
    m = F.col("`Task Metrics`")
    of = lambda *names: F.coalesce(_field(m, *names), F.lit(0))
    ended = events.where("Event = 'SparkListenerTaskEnd'")
    return ended.select(
        F.col("`Stage ID`").alias("stage"),
        F.col("`Task Info`")["Task ID"].alias("task"),
        F.col("`Task Info`")["Failed"].alias("failed"),
        (of("Executor Run Time") / 1e3).alias("run_s"),
        (of("Executor CPU Time") / 1e9).alias("cpu_s"),
        (of("JVM GC Time") / 1e3).alias("gc_s"),
        of("Peak Execution Memory").alias("peak_bytes"),
        (of("Memory Bytes Spilled") + of("Disk Bytes Spilled")).alias("spilled_bytes"),
        of("Shuffle Write Metrics", "Shuffle Bytes Written").alias("shuffle_written_bytes"),
        (of("Shuffle Read Metrics", "Remote Bytes Read") + of("Shuffle Read Metrics", "Local Bytes Read")).alias("shuffle_read_bytes"),
        of("Input Metrics", "Bytes Read").alias("input_bytes"),
        of("Input Metrics", "Records Read").alias("input_rows"),
    )


def _field(column, *names):
    for name in names:
        column = column[name]
    return column


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("tasks"), F.max("peak_bytes").alias("peak_bytes"), F.max("run_s").alias("longest_s"), *[F.sum(c).alias(c) for c in MEASURES])


def stage_usage(events: DataFrame) -> DataFrame:
    """One row a stage: its tasks, the sums of what they used, the greatest peak, and the longest task."""
    return _sums(task_usage(events), ["stage"])


def group_usage(events: DataFrame) -> DataFrame:
    """The same by job group (null for jobs without one). A stage counts for the first job that lists it."""
    jobs = events.where("Event = 'SparkListenerJobStart'").select(F.col("Properties")["spark.jobGroup.id"].alias("job_group"), F.explode("`Stage IDs`").alias("stage"), F.monotonically_increasing_id().alias("_at"))
    owner = jobs.groupBy("stage").agg(F.min_by("job_group", "_at").alias("job_group"))
    return _sums(task_usage(events).join(owner, "stage", "left"), ["job_group"])
