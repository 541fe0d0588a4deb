"""Incremental scoring with Structured Streaming: each journal entry once, with work that does not grow with the journal."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.bits import score64
from ..functions.canonical import canonical_json
from ..functions.shared import create_absent, get_text
from ..operators.retrieval import nearest


def candidate_stream(spark: SparkSession, path: str, schema: str | StructType, per_trigger: int = 4) -> DataFrame:
    """Journal files (JSON lines) as a stream; few a trigger keep the work in flight small.

    Files are whole when they appear in the folder, as by a rename. Blank lines are skipped; a malformed line is an error
    and stops the stream."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*kind.fields]).add("_bad", "string")
    lines = spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", per_trigger).load(path).where("trim(value) <> ''")
    row = F.from_json("value", whole, {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.select("value", row.alias("row"))
    checked = F.when(F.col("row").isNull() | F.col("row._bad").isNotNull(), F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200)))).otherwise(F.col("row"))
    return parsed.select(checked.alias("row")).select("row.*").drop("_bad")


def counted_stream(rows: DataFrame, key: str) -> DataFrame:
    """(key, times, row) of each key that a batch brings, for output mode update: how often it has come in all, and the
    first row of it. State is a number and a row a key, in the checkpoint's state store, so what came before is never
    read again; with very many keys, use the RocksDB store, which keeps state on disk."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("times"), F.first(F.struct(*rows.columns)).alias("row"))


def score_stream(
    candidates: DataFrame,
    registry: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "candidate_id",
    others: bool = False,
    design: DataFrame | None = None,
    labels: tuple[str, ...] = (),
    signature: dict[str, str] | None = None,
) -> StreamingQuery:
    """The nearest registered parent (id, hash) of each streamed candidate (key bigint, hash), written once a candidate.

    Each micro-batch is an exact search, whatever the distance. A batch replaces itself when it is repeated. A key that
    comes twice, in one batch or in two, is an error of the journal and stops the stream; so are a candidate without a key
    and, with ``design``, one whose labels differ from the fixed design. A candidate without a hash has no parent, and
    status not_evaluated. With ``signature``, digests of code and manifests, a run that began with others is not resumed."""
    if signature is not None:
        begin_run(candidates.sparkSession, path, signature)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # its state is updated once
        try:
            if found := batch.where("times > 1 OR key IS NULL").limit(5).collect():
                raise ValueError(f"candidates came twice or without a key: {[r.key for r in found]}")
            rows = batch.select("row.*")
            if design is not None and (found := label_drift(rows, design, key, list(labels)).limit(5).collect()):
                raise ValueError(f"candidates diverge from the fixed design: {[r[key] for r in found]}")
            best = nearest(rows.select(F.col(key).alias("id"), "hash"), registry, 1, others).select(F.col("candidate").alias(key), "parent", "distance")
            out = rows.select(key).join(best, key, "left").withColumns({"score": score64(F.col("distance")), "status": F.when(F.col("distance").isNull(), "not_evaluated").otherwise("evaluated")})
            out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    counted = counted_stream(candidates, key)
    return counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_drift(streamed: DataFrame, design: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Rows whose labels differ from the fixed design, or that it does not have."""
    fixed = design.select(key, *[F.col(c).alias(f"d_{c}") for c in labels], F.lit(True).alias("_known"))
    same = F.col("_known").isNotNull()
    for c in labels:
        same = same & F.col(c).eqNullSafe(F.col(f"d_{c}"))
    return streamed.join(fixed, key, "left").where(~same).select(*streamed.columns)


def resume_guard(recorded: dict[str, str], current: dict[str, str]) -> None:
    """Refuse to go on with other code or manifests than a run began with."""
    changed = sorted(k for k in recorded.keys() | current.keys() if recorded.get(k) != current.get(k))
    if changed:
        raise ValueError(f"changed since the run began: {changed}")


def begin_run(spark: SparkSession, path: str, signature: dict[str, str]) -> None:
    """Record what a run begins with beside its output, once; refuse to resume it with anything else."""
    where = f"{path}/_run.json"
    if not create_absent(spark, where, canonical_json(signature)):
        resume_guard(json.loads(get_text(spark, where)), signature)
