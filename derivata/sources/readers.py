"""Readers: manifests, journals, digest-guarded documents and directories of files."""

from __future__ import annotations

import importlib.metadata
import json
import platform
import shutil
import subprocess
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.canonical import digest_of
from ..functions.ordinals import numbered
from ..operators.partitioning import leaks

SUFFIXES = ("mp4", "mkv", "webm", "mov", "avi")

ASSETS = "asset_id string, filename string, path string, sha256 string, duration_s double, width int, height int, fps double, has_audio boolean, category string, role string, license_note string, extra map<string,string>"
GROUND_TRUTH = (
    "candidate_id string, source_id string, is_derivative boolean, source_intervals_ms array<array<bigint>>, candidate_intervals_ms array<array<bigint>>, visual_ancestry boolean, audio_ancestry boolean, "
    "transcript_ancestry boolean, transformations array<string>, candidate_sha256 string, candidate_path string, clip_length_s double, extra map<string,string>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def read_manifest(spark: SparkSession, path: str, schema: str | StructType = ASSETS) -> DataFrame:
    """A JSON document that is an array of records; unlike inference, a schema costs no pass over the data."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth records with intervals as structs of milliseconds."""
    pairs = lambda c: F.transform(c, lambda x: F.struct(x[0].alias("start_ms"), x[1].alias("end_ms"))).alias(c)
    df = read_manifest(spark, path, GROUND_TRUTH)
    return df.select(*[pairs(c) if c.endswith("_ms") else F.col(c) for c in df.columns])


def read_journal(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; a missing file is empty and blank lines are skipped. A malformed line is an error, but for a file's
    last line, which may be still being written: that one is left for the next reading."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*kind.fields]).add("_bad", "string")
    # Line feeds alone end lines. A line belongs to the split where it begins, and a split's lines come in their order, so
    # a file's last line has the greatest of these places, wherever splits end.
    m = F.col("_metadata")
    place = F.struct(m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path, lineSep="\n").select("value", m["file_path"].alias("file"), place.alias("place"))
    parsed = lines.where("trim(value) <> ''").withColumn("row", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    lasts = lines.groupBy("file").agg(F.max("place").alias("last"))
    error = F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200))).cast("boolean")
    refused = parsed.where(bad).join(lasts, "file", "left").where(F.when(F.col("place") == F.col("last"), F.lit(False)).otherwise(error))
    return parsed.where(~bad).select("row").union(refused.select("row")).select("row.*").drop("_bad")


def read_partition(spark: SparkSession, path: str, schema: str | StructType = "id string, identity_group string, component_id string, partition string") -> DataFrame:
    """A partition manifest, its own digest checked; refused if it leaks."""
    document = read_own_digest(spark, path)
    rows = spark.createDataFrame([Row(**{f.name: r.get(f.name) for f in _fields(schema)}) for r in document["assignments"]], schema) if document["assignments"] else spark.createDataFrame([], schema)
    if found := leaks(rows).limit(5).collect():
        raise ValueError(f"the partition leaks: {[tuple(r) for r in found]}")
    return rows


def _fields(schema: str | StructType):
    return (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields


def read_own_digest(spark: SparkSession, path: str, field: str = "sha256") -> dict:
    """One small document that holds the digest of the rest of it; ValueError if it is another."""
    document = json.loads(spark.read.text(path, wholetext=True).first().value)
    if document.get(field) != digest_of({k: v for k, v in document.items() if k != field}):
        raise ValueError(f"digest mismatch: {path}")
    return document


def read_profile(spark: SparkSession, path: str) -> dict:
    """A threshold profile, its own digest checked."""
    return read_own_digest(spark, path, "profile_sha256")


def changed_digests(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(name, recorded, current) of files whose digest (name, sha256) is not the recorded one, or is on one side only."""
    both = recorded.select("name", F.col("sha256").alias("recorded")).join(current.select("name", F.col("sha256").alias("current")), "name", "full_outer")
    return both.where(~F.col("recorded").eqNullSafe(F.col("current")))


def registry_of(assets: DataFrame, files: DataFrame, partition: str) -> DataFrame:
    """Sources of a partition (asset_id, path, sha256, role, partition), refused if a file's digest (path, sha256) is not
    the registered one."""
    rows = assets.where((F.col("role") == "source") & (F.col("partition") == partition))
    found = files.select("path", F.col("sha256").alias("_now"))
    return rows.join(found, "path", "left").where(F.when(F.col("_now").eqNullSafe(F.col("sha256")), True).otherwise(F.raise_error(F.concat(F.lit("source changed: "), F.col("path"))).cast("boolean"))).drop("_now")


def read_guarded(spark: SparkSession, path: str) -> str:
    """A document whose digest its sidecar ``path.sha256`` records; ValueError if they differ. One small document."""
    text = spark.read.text(path, wholetext=True).select("value", F.sha2("value", 256).alias("d")).first()
    want = spark.read.text(f"{path}.sha256", wholetext=True).first().value.split()[0]
    if text.d != want:
        raise ValueError(f"digest mismatch: {path}")
    return text.value


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(read_guarded(spark, path))


def scan_directory(spark: SparkSession, path: str, role: str) -> DataFrame:
    """(asset_id, filename, path, size_bytes, sha256, role) of media files, numbered by path from the role's initial.

    Numbers come from per-partition counts of a range partitioning, so no single task sorts all paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    rows = kept.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return numbered(rows, "path").withColumn("asset_id", F.concat(F.lit(role[0].upper()), F.lpad(F.col("number").cast("string"), 3, "0"))).select("asset_id", "filename", "path", "size_bytes", "sha256", F.lit(role).alias("role"))


def valid_media(rows: DataFrame, longest: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """Probe rows that are usable (a video stream, 0 < duration <= longest), and the rest with a reason."""
    seconds = F.col("duration_s")
    reason: Column = (
        F.when(F.coalesce(F.col("width") * F.col("height"), F.lit(0)) <= 0, "no_video_stream")
        .when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "no_duration")
        .when(seconds > longest, "too_long")
    )
    judged = rows.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def media_table(spark: SparkSession, path: str, command: tuple[str, ...] = ("ffprobe", "-v", "error", "-show_format", "-show_streams", "-of", "json")) -> DataFrame:
    """(path, probe, reason): the probe's JSON of each media file below a path. Where the tool is not installed on a
    worker, or fails, probe is null and reason says so; nothing counts as zero."""

    def run(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append((name, *_tool(command, content)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 3)], names=["path", "probe", "reason"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, probe string, reason string")


def _tool(command: tuple[str, ...], content: bytes) -> tuple[str | None, str | None]:
    if shutil.which(command[0]) is None:
        return None, f"not_installed: {command[0]}"
    with tempfile.NamedTemporaryFile() as file:  # gone when the tool has run
        file.write(content)
        file.flush()
        done = subprocess.run([*command, file.name], capture_output=True, timeout=120, check=False)
    return (done.stdout.decode("utf-8", "replace"), None) if done.returncode == 0 else (None, f"failed: {done.stderr.decode('utf-8', 'replace')[:180]}")


def media_properties(probed: DataFrame) -> DataFrame:
    """(path, duration_s, width, height, fps, has_audio, codec_video, codec_audio, reason) from :func:`media_table`."""
    stream = "array<struct<codec_type: string, codec_name: string, width: int, height: int, r_frame_rate: string>>"
    parsed = probed.withColumn("p", F.from_json("probe", f"format struct<duration: string>, streams {stream}"))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), 0)
    video, audio = first("video"), first("audio")
    return parsed.select("path", F.col("p.format.duration").try_cast("double").alias("duration_s"), video["width"].alias("width"), video["height"].alias("height"), frame_rate(video["r_frame_rate"]).alias("fps"), audio.isNotNull().alias("has_audio"), video["codec_name"].alias("codec_video"), audio["codec_name"].alias("codec_audio"), "reason")


def frame_times_of(log: Column) -> Column:
    """The presentation times that a decoder's log shows (pts_time:...), in order."""
    return F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:([0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))


def nearest_height(variants: DataFrame, by: str, height: int = 720) -> DataFrame:
    """Of each item's variants (by, height, url), the one whose height is nearest (ties: the lower, then by url)."""
    key = F.struct(F.abs(F.col("height") - height).alias("off"), F.col("height"), F.col("url"))
    return variants.where("height IS NOT NULL").groupBy(by).agg(F.min(key).alias("k")).select(by, "k.height", "k.url")


def environment(spark: SparkSession) -> DataFrame:
    """One row: the versions that results depend on."""
    names = ("pyspark", "numpy", "pandas", "pyarrow")
    versions = {n: importlib.metadata.version(n) for n in names}
    return spark.createDataFrame([(platform.python_version(), platform.system(), versions)], "python string, system string, packages map<string,string>")


def frame_rate(text: Column) -> Column:
    """num/den as a rate; 0 where den is 0."""
    parts = F.split(text, "/")
    return F.coalesce(F.try_divide(F.try_element_at(parts, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).try_cast("double")), F.lit(0.0))
