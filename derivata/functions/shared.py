"""The folder that driver and executors share, and small files in any store that Spark reaches."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a new local folder where that is unset and all is local."""
    for conf in (spark.conf, spark.sparkContext.getConf()):
        if found := conf.get("spark.checkpoint.dir", None):
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="derivata-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names_in(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of its last change in ms) of what is in a folder; nothing if there is none."""
    fs, where = _at(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(where)] if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is no file. No job is run."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    fs, where = _at(spark, path)
    out = fs.create(where, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def create_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with all of its text at once, unless there is one; whether it was created.

    The text goes to a file of another name, which then gets this one: by a hard link on a local disk, and by a rename
    that refuses to replace in other stores (which must keep that promise, as HDFS does)."""
    fs, where = _at(spark, path)
    other = f"{path}.{uuid.uuid4().hex}"
    fs.mkdirs(where.getParent())
    put_text(spark, other, text, False)
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: _at(spark, p)[1].toUri().getPath()
            try:
                os.link(local(other), local(path))
            except FileExistsError:
                return False
            return True
        hadoop = spark._jvm.org.apache.hadoop.fs
        options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(_at(spark, other)[1], where, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True
    finally:
        delete(spark, other)
