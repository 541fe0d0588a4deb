"""Lineage cuts and sizes that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process wrote and has not dropped.
_written: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new local one where unset."""
    for conf in (spark.conf, spark.sparkContext.getConf()):
        if found := conf.get("spark.checkpoint.dir", None):
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="derivata-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write(df: DataFrame, path: str) -> None:
    """Write Parquet and free the job's shuffle files when it ends."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, noted for :func:`sweep`."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read back; and its path, for :func:`drop`."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`cut` wrote and nothing reads any more."""
    for path in paths:
        fs, where = _fs(spark, path)
        fs.delete(where, True)
        if path in _written:
            _written.remove(path)


def written() -> frozenset[str]:
    """The tables that this process wrote and has not dropped."""
    return frozenset(_written)


def sweep(spark: SparkSession) -> int:
    """Delete what operators of this process left in the shared folder because their results, which are lazy, read it; to
    be called when these have been written elsewhere. How many tables went."""
    left = list(_written)
    drop(spark, *left)
    return len(left)


def buckets(spark: SparkSession, each: int = 8) -> int:
    """How many hash buckets packed messages go to: some for each shuffle partition, so that they even out."""
    return each * int(spark.conf.get("spark.sql.shuffle.partitions"))
