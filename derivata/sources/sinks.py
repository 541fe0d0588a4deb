"""Sinks: canonical documents with digests, immutable writes, content-addressed tables and journals."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, digest_of
from ..functions.shared import exists
from ..operators.evidence import new_artifacts
from . import commits


def _put(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row.value if row else ""


def dump(spark: SparkSession, path: str, document, immutable: bool = True) -> str:
    """Write one small document canonically, with a digest beside it. An immutable one that differs is refused."""
    text = canonical_json(document)
    digest = hashlib.sha256(text.encode()).hexdigest()
    have = _get(spark, path)
    if have is not None and have != text and immutable:
        raise ValueError(f"refusing to change {path}")
    if have != text:
        _put(spark, path, text, overwrite=not immutable)
        _put(spark, f"{path}.sha256", digest, overwrite=True)
    return digest


def with_own_digest(document: dict, field: str = "sha256") -> dict:
    """The document and the digest of the rest of it."""
    rest = {k: v for k, v in document.items() if k != field}
    return {**rest, field: digest_of(rest)}


def _count(seen: Observation) -> int:
    """What was observed; where rows turn out to be none while the job runs, Spark drops the plan with its observation."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0


def _appended(rows: DataFrame, path: str) -> int:
    """Append rows to a table by prefix of their digests; how many, counted as they are written."""
    seen = Observation()
    counted = rows.withColumn("prefix", F.substring("digest", 1, 2)).observe(seen, F.count(F.lit(1)).alias("n"))
    counted.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)
    return _count(seen)


def put_artifacts(incoming: DataFrame, path: str) -> int:
    """Append artifacts (content) that are not stored yet to a table by digest; returns how many."""
    spark = incoming.sparkSession
    stored = spark.read.parquet(path).select("digest") if exists(spark, path) else spark.createDataFrame([], "digest string")
    return _appended(new_artifacts(incoming, stored).select("digest", "content"), path)


class DigestStore:
    """A content-addressed store in ``buckets`` buckets of digests, at a path of its own.

    The stored side of every join by digest is read bucket by bucket as it lies: no shuffle moves it, however large it is;
    only what is asked for goes to its buckets. Rows are sorted in each file. The store is a table of the session's
    catalog; :meth:`compact` puts the files of many puts together into one a bucket, in a new folder that a commit names."""

    def __init__(self, spark: SparkSession, path: str, content: str = "string", buckets: int = 200):
        self.spark, self.path = spark, path
        now = commits.state(spark, path)
        if not now.version:
            first = {"buckets": buckets, "content": content, "folder": f"files/{uuid.uuid4().hex}"}
            now = commits.commit(spark, path, lambda s: None if s.version else commits.Change(head=first, reason="store"))
        self._open(now.head)

    def _open(self, head: dict) -> None:
        self.buckets, self.content, self.folder = head["buckets"], head["content"], head["folder"]
        self.name = f"digests_{hashlib.sha256(f'{self.path}/{self.folder}'.encode()).hexdigest()[:24]}"
        location = f"{self.path}/{self.folder}".replace("'", "")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, content {self.content}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'")

    def rows(self) -> DataFrame:
        """(digest, content) of all that is stored."""
        return self.spark.table(self.name)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "digest").select("digest", "content")

    def put(self, incoming: DataFrame) -> int:
        """Add contents (content) that are not stored yet; how many, counted as they are written. One writer at a time."""
        seen = Observation()
        named = incoming.where("content IS NOT NULL").select(F.sha2("content", 256).alias("digest"), "content").dropDuplicates(["digest"])
        fresh = self._dealt(named).join(self.rows().select("digest").hint("merge"), "digest", "left_anti").select("digest", "content")
        fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(self.name)
        return _count(seen)

    def get(self, wanted: DataFrame) -> DataFrame:
        """(digest, content) of the ``wanted`` digests that are stored; an error if a content is not that of its digest."""
        asked = wanted.select("digest").distinct()
        found = self.rows().join(asked.hint("shuffle_merge"), "digest", "left_semi")
        spoilt = F.raise_error(F.concat(F.lit("not the content of "), F.col("digest"))).cast("boolean")
        return found.where(F.when(F.col("digest") == F.sha2("content", 256), True).otherwise(spoilt))

    def compact(self) -> int:
        """Rewrite the store as one file a bucket; the number of files before."""
        before = len(self.rows().inputFiles())
        # By its path: of a bucketed table, Spark takes the repartitioning for done, and then reads it unbucketed.
        old = self.spark.read.schema(self.rows().schema).parquet(f"{self.path}/{self.folder}")

        def change(now: commits.State) -> commits.Change:
            head = {**now.head, "folder": f"files/{uuid.uuid4().hex}"}
            self._open(head)
            self._dealt(old).write.insertInto(self.name)
            return commits.Change(head=head, reason="compact")

        commits.commit(self.spark, self.path, change)
        return before


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def digest_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr("path", "length AS size_bytes", "sha2(content, 256) AS sha256")


def stage(spark: SparkSession, path: str, most: int = 512 << 20) -> tuple[DataFrame, DataFrame]:
    """(path, size_bytes, sha256, content) of the files below a landing folder, and the refused ones with a reason. Files
    beyond ``most`` bytes are refused by their length and not read; Spark reads no empty files, so they are not staged."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("reason", F.when(F.col("length") > most, "too_large"))
    good = files.where("reason IS NULL").selectExpr("path", "length AS size_bytes", "sha2(content, 256) AS sha256", "content")
    return good, files.where("reason IS NOT NULL").selectExpr("path", "length AS size_bytes", "reason")


def persist_media(staged: DataFrame, path: str) -> int:
    """Append staged files to a content-addressed table (digest, size_bytes, content), each content once; how many were
    new. A file whose bytes are not those of its digest is an error."""
    spark = staged.sparkSession
    there = exists(spark, path)
    kind = "digest string, size_bytes bigint, content binary"
    stored = spark.read.schema(kind + ", prefix string").parquet(path).select("digest") if there else spark.createDataFrame([], "digest string")
    right = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not the bytes of "), F.col("sha256"))).cast("binary"))
    rows = staged.select(F.col("sha256").alias("digest"), "size_bytes", right.alias("content")).dropDuplicates(["digest"]).join(stored, "digest", "left_anti")
    return _appended(rows, path)


def export(rows: DataFrame, path: str, *order: str) -> DataFrame:
    """Write rows as JSON lines, sorted within files, and give the digest of each file (path, size_bytes, sha256)."""
    (rows.sortWithinPartitions(*order) if order else rows).write.mode("errorifexists").json(path)
    return digest_index(rows.sparkSession, path).where(F.col("path").rlike(r"/part-[^/]*$"))


def _content_digest(spark: SparkSession, path: str) -> str:
    """The digest of the digests of a folder's files, in their order; a line a file."""
    lines = digest_index(spark, path).agg(F.array_join(F.array_sort(F.collect_list("sha256")), "\n").alias("x"))
    return lines.select(F.sha2("x", 256)).first()[0]


def revise(rows: DataFrame, path: str, reason: str) -> int:
    """Make rows the next version of a table; its number. Versions before stay. Rows are written first; then one commit
    puts them, with the digest of their files, in the place of those before. Of two writers at once, one comes after."""
    spark = rows.sparkSession
    folder = commits.staged(rows, path, "rows")
    head = {"sha256": _content_digest(spark, f"{path}/{folder}")}
    return commits.commit(spark, path, lambda now: commits.Change(replace={"rows": folder}, head=head, reason=reason)).version


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version that :func:`revise` made, the last one by default."""
    return commits.read(spark, path, "rows", version)


def revision_is_whole(spark: SparkSession, path: str, version: int | None = None) -> bool:
    """Whether the files of a version are those that were written."""
    now = commits.state(spark, path, version)
    return _content_digest(spark, f"{path}/{now.tables['rows'][0]}") == now.head["sha256"]


def markdown_table(rows: DataFrame, *columns: str, most: int = 500) -> str:
    """A report's table of a small result; more than ``most`` rows are refused, not cut."""
    found = rows.select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no table for a report")
    show = lambda v: "not evaluated" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [columns, ["---"] * len(columns), *[[show(v) for v in r] for r in found]]
    return "".join("| " + " | ".join(x) + " |\n" for x in lines)
