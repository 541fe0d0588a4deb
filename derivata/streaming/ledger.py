"""The append-only event log: rows, their events and the checkpoint over them in one commit."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.shared import delete
from ..operators.evidence import GENESIS, chained_batches, checkpoints
from ..sources import commits

_CHAIN = "log string, seq bigint, previous_hash string, event_hash string, body string"


def record(spark: SparkSession, path: str, events: DataFrame, rows: dict[str, DataFrame] | None = None, seed: bytes | None = None, at: str = "1970-01-01T00:00:00+00:00", step: tuple[str, int] | None = None) -> commits.State:
    """Add ``events`` (kind, subject, document) to the store's log, and ``rows`` to its tables, all in one commit.

    Events are sorted by subject and document, on disk if need be, and one task chains them from the head on, which the
    last commit holds: the log itself is not read, and a chain has one writer by nature. With a ``seed``, each event has a
    signed checkpoint beside it (checkpoint, else null). A ``step`` (stream, number) that the store has already is not
    done again. Other writers only cost another try: the chain is made anew from their head."""
    body = F.concat_ws("|", "kind", "subject", F.sha2(F.coalesce("document", F.lit("")), 256))
    kept = {name: commits.staged(df, path, name) for name, df in (rows or {}).items()} if step is None or commits.state(spark, path).head.get("steps", {}).get(step[0], -1) < step[1] else {}

    made_here: list[str] = []

    def change(now: commits.State) -> commits.Change | None:
        steps = dict(now.head.get("steps", {}))
        if step is not None:
            if steps.get(step[0], -1) >= step[1]:
                return None
            steps[step[0]] = step[1]
        seq, head = now.head.get("seq", 0), now.head.get("event_hash", GENESIS)
        named = events.select(F.lit("log").alias("log"), "subject", body.alias("body"))
        chain = named.repartition(1).sortWithinPartitions("subject", "body").mapInArrow(chained_batches(head, seq), _CHAIN)
        links = commits.staged(chain, path, "links")  # sequential, so done once
        made_here.append(links)
        made = spark.read.schema(_CHAIN).parquet(f"{path}/{links}")
        last = made.agg(F.max(F.struct("seq", "event_hash")).alias("x")).first().x
        if seed is None:
            marked = made.withColumn("checkpoint", F.lit(None).cast("string"))
        else:
            marked = made.join(checkpoints(made, seed, at).select("seq", F.col("envelope").alias("checkpoint")), "seq")
        after = {"seq": last.seq if last else seq, "event_hash": last.event_hash if last else head, "steps": steps}
        return commits.Change(append={"events": marked.drop("log"), **kept}, head=after, reason="record")

    after = commits.commit(spark, path, change)
    for links in made_here:
        delete(spark, f"{path}/{links}")
    return after


def read_log(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(log, seq, previous_hash, event_hash, body, checkpoint) of all events."""
    return commits.read(spark, path, "events", version).withColumn("log", F.lit("log"))


def log_stream(events: DataFrame, path: str, checkpoint: str, seed: bytes | None = None, at: str = "1970-01-01T00:00:00+00:00") -> StreamingQuery:
    """Each micro-batch of a stream (kind, subject, document) as one commit of the log at ``path``. The commit names the
    stream (by its checkpoint folder) and the batch, so that a batch that is repeated after a failure adds nothing."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def put(batch: DataFrame, number: int) -> None:
        record(batch.sparkSession, path, batch, seed=seed, at=at, step=(stream, number))

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
