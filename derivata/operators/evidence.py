"""Evidence: hash-chained logs, content-addressed tables, lineage with validity in time, and bundle checks."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import is_digest
from ..functions.ordinals import checkpointed, greatest_before, numbered, running_sums
from ..functions.signatures import signed, sound_column, verified

GENESIS = "0" * 64


def link_digest(previous: Column, body: Column) -> Column:
    """Digest of an event: of the one before, and its own body."""
    return F.sha2(F.concat_ws("\n", previous, body), 256)


_LINK = [("seq", pa.int64()), ("previous_hash", pa.string()), ("event_hash", pa.string()), ("body", pa.string())]


def chained_batches(head: str = GENESIS, seq: int = 0):
    """Rows (log, seq, previous_hash, event_hash, body) from rows (log, ..., body) in order, for mapInArrow: each log from
    ``seq`` and ``head`` on. Only the last digest is kept."""

    def run(batches):
        log, last, at, begun = None, head, seq, False
        for batch in batches:
            out = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if not begun or key != log:
                    log, last, at, begun = key, head, seq, True
                at += 1
                digest = hashlib.sha256(f"{last}\n{body or ''}".encode()).hexdigest()
                out.append((key, at, last, digest, body))
                last = digest
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (batch.schema.field(0).type, *(t for _, t in _LINK))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["log", *(n for n, _ in _LINK)])

    return run


def build_chain(events: DataFrame, log: str, order: str, body: str) -> DataFrame:
    """(log, seq, previous_hash, event_hash, body): each log's events in order (ties by body), chained by digests.

    A chain is sequential by nature. A log's events stream through one task, sorted on disk if need be, and only the
    last digest is kept; logs run side by side."""
    rows = events.select(F.col(log).alias("log"), F.col(order).alias("at"), F.coalesce(body, F.lit("")).alias("body"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["log"].dataType.simpleString()
    return rows.repartition(n, "log").sortWithinPartitions("log", "at", "body").mapInArrow(chained_batches(), f"log {kind}, seq bigint, previous_hash string, event_hash string, body string")


def chain_violations(chain: DataFrame) -> DataFrame:
    """(log, seq, reason) where an event does not follow from the one before it. By equi-join with the predecessor, so
    one long log is checked by all tasks."""
    before = chain.select("log", (F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("expected"))
    joined = chain.join(before, ["log", "seq"], "left").withColumn("expected", F.coalesce("expected", F.when(F.col("seq") == 1, F.lit(GENESIS))))
    reason = F.when(~F.col("previous_hash").eqNullSafe(F.col("expected")), "event_chain_mismatch").when(~F.col("event_hash").eqNullSafe(link_digest(F.col("previous_hash"), F.col("body"))), "event_chain_mismatch")
    return joined.select("log", "seq", reason.alias("reason")).where("reason IS NOT NULL")


def log_status(chain: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One row a log: n_events, valid, first_bad_seq and reason, chain first, then count and head of its checkpoint
    (log, sequence, head)."""
    bad = chain_violations(chain).groupBy("log").agg(F.min(F.struct("seq", "reason")).alias("bad"))
    heads = chain.groupBy("log").agg(F.count("*").alias("n_events"), F.max_by("event_hash", "seq").alias("last_hash"))
    out = heads.join(bad, "log", "left").join(checkpoints, "log", "left")
    reason = F.when(F.col("bad").isNotNull(), F.col("bad.reason")).when(~F.col("sequence").eqNullSafe(F.col("n_events")), "checkpoint_count_mismatch").when(~F.col("head").eqNullSafe(F.col("last_hash")), "checkpoint_mismatch")
    return out.select("log", "n_events", reason.isNull().alias("valid"), F.col("bad.seq").alias("first_bad_seq"), reason.alias("reason"))


def checkpoints(chain: DataFrame, seed: bytes, at: str) -> DataFrame:
    """(log, seq, envelope): a signed checkpoint of each event, which binds the log up to it."""
    payload = F.to_json(F.struct(F.lit("checkpoint-v1").alias("schema"), F.col("seq").alias("sequence"), F.col("event_hash").alias("log_head_sha256"), F.lit(at).alias("signed_at")))
    return chain.select("log", "seq", signed(payload, seed).alias("envelope"))


def signed_log_status(chain: DataFrame, marks: DataFrame, trusted: str) -> DataFrame:
    """One row a log: n_events, valid, reason and sequence of its first fault: a break of the chain, then a number of
    checkpoints that is not that of events, then one that does not bind its event or is not the trusted signer's."""
    bad = chain_violations(chain).groupBy("log").agg(F.min("seq").alias("broken"))
    n = chain.groupBy("log").agg(F.count("*").alias("n_events")).join(marks.groupBy("log").agg(F.count("*").alias("n_marks")), "log", "full_outer")
    said = lambda name, kind: F.get_json_object("envelope", f"$.payload.{name}").try_cast(kind)
    both = chain.join(marks, ["log", "seq"], "left")
    binds = sound_column(F.col("envelope"), trusted) & said("sequence", "bigint").eqNullSafe(F.col("seq")) & said("log_head_sha256", "string").eqNullSafe(F.col("event_hash"))
    loose = both.where(~binds).groupBy("log").agg(F.min("seq").alias("loose"))
    out = n.join(bad, "log", "left").join(loose, "log", "left")
    count = F.coalesce("n_events", F.lit(0)) != F.coalesce("n_marks", F.lit(0))
    reason = F.when(F.col("broken").isNotNull(), "event_chain_mismatch").when(count, "checkpoint_count_mismatch").when(F.col("loose").isNotNull(), "checkpoint_mismatch")
    where = F.when(F.col("broken").isNotNull(), F.col("broken")).when(~count, F.col("loose"))
    return out.select("log", F.coalesce("n_events", F.lit(0)).alias("n_events"), reason.isNull().alias("valid"), reason.alias("reason"), where.alias("sequence"))


def latest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each group, by an order without ties, as one struct aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*by, "last.*")


def new_artifacts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(digest, content) of artifacts to append: each once, none that is stored."""
    rows = incoming.where("content IS NOT NULL").select(F.sha2("content", 256).alias("digest"), "content").dropDuplicates(["digest"])
    return rows.join(stored.select("digest"), "digest", "left_anti")


def damaged(artifacts: DataFrame) -> DataFrame:
    """Digests that are none, or not those of their content."""
    return artifacts.where(~is_digest(F.col("digest")) | ~F.col("digest").eqNullSafe(F.sha2("content", 256))).select("digest")


def without_revoked(authorizations: DataFrame, revocations: DataFrame) -> DataFrame:
    """Authorizations with revoked_at of their first revocation; revoking twice changes nothing."""
    first = revocations.groupBy("authorization_id").agg(F.min("revoked_at").alias("revoked_at"))
    return authorizations.drop("revoked_at").join(first, "authorization_id", "left")


def revoke(authorizations: DataFrame, revocations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Authorizations as they are after ``revocations`` (authorization_id, revoked_at), the events (kind, subject,
    document) of those that changed, and the ids that are none. What is revoked already keeps its time and makes no event;
    of several revocations the first counts. Rows and events belong in one commit (``streaming.ledger.record``)."""
    first = revocations.where("authorization_id IS NOT NULL").groupBy("authorization_id").agg(F.min("revoked_at").alias("_at"))
    both = authorizations.join(first, "authorization_id", "left")
    after = both.withColumn("revoked_at", F.coalesce("revoked_at", "_at")).select(*authorizations.columns)
    changed = both.where("revoked_at IS NULL AND _at IS NOT NULL")
    document = F.to_json(F.struct(F.col("_at").alias("revoked_at")))
    events = changed.select(F.lit("authorization_revoked").alias("kind"), F.col("authorization_id").alias("subject"), document.alias("document"))
    return after, events, first.join(authorizations, "authorization_id", "left_anti").select("authorization_id")


def verified_artifacts(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, content) of the ``wanted`` (digest) artifacts; an error if one's content is not that of its digest, or if it
    is not there."""
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.col("digest"))).cast("boolean")
    found = wanted.select("digest").distinct().join(stored.select("digest", "content"), "digest", "left")
    good = F.when(F.col("content").isNull(), fail("no artifact of ")).when(~F.col("digest").eqNullSafe(F.sha2("content", 256)), fail("not the content of ")).otherwise(True)
    return found.where(good)


def audit(results: DataFrame, artifacts: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """What a report's audit says, as rows (topic, key, n): results (partition, status) by partition and status, artifacts
    (digest, content) that were checked and those that are damaged, files (name, sha256) that are not as recorded, and
    whether all passed (n is 1)."""
    row = lambda df, topic, key, n: df.select(F.lit(topic).alias("topic"), key.cast("string").alias("key"), n.cast("bigint").alias("n"))
    states = results.groupBy("partition", "status").agg(F.count("*").alias("n"))
    out = row(states, "results", F.concat_ws("/", "partition", "status"), F.col("n"))
    bad = damaged(artifacts).agg(F.count("*").alias("damaged"))
    changed = recorded.select("name", F.col("sha256").alias("r")).join(current.select("name", F.col("sha256").alias("c")), "name", "full_outer").where(~F.col("r").eqNullSafe(F.col("c"))).agg(F.count("*").alias("changed"))
    one = artifacts.agg(F.count("*").alias("checked")).crossJoin(bad).crossJoin(changed)  # one row each
    passed = ((F.col("damaged") == 0) & (F.col("changed") == 0)).cast("int")
    facts = F.array(*[F.struct(F.lit(t).alias("topic"), n.cast("bigint").alias("n")) for t, n in (("artifacts_checked", F.col("checked")), ("artifacts_damaged", F.col("damaged")), ("files_changed", F.col("changed")), ("passed", passed))])
    return out.unionByName(one.select(F.inline(facts)).select("topic", F.lit(None).cast("string").alias("key"), "n"))


def lineage(children: DataFrame, derivatives: DataFrame, assets: DataFrame, authorizations: DataFrame, at: Column) -> DataFrame:
    """(child, parent_id, authorization_id, state) of registered derivations of each child at a time.

    The parent must be registered. An authorization counts if it is not revoked, names parent and child, and holds at
    that time, both ends included: ``authorized``; otherwise ``unauthorized``."""
    known = children.join(derivatives.select("child_sha256", "parent_id", F.col("authorization_id").alias("claimed")), "child_sha256")
    known = known.join(assets.select(F.col("id").alias("parent_id")).distinct(), "parent_id").withColumn("checked_at", at)
    a = authorizations.where("revoked_at IS NULL").select(F.col("authorization_id").alias("claimed"), F.col("parent_id").alias("_parent"), F.col("child_sha256").alias("_child"), "valid_from", "valid_until")
    joined = known.join(a, "claimed", "left")
    holds = F.coalesce((F.col("_parent") == F.col("parent_id")) & (F.col("_child") == F.col("child_sha256")) & F.col("checked_at").between(F.col("valid_from"), F.col("valid_until")), F.lit(False))
    return joined.select("child", "parent_id", F.when(holds, F.col("claimed")).alias("authorization_id"), F.when(holds, "authorized").otherwise("unauthorized").alias("state"))


def _cover(df: DataFrame, levels: int, width: float) -> DataFrame:
    """``df`` (a, b, ...) with level and cell of the dyadic cells that make up each interval: cells of ``width`` at level 0,
    of twice as much at each further level, two a level at most. No place is in two of an interval's cells."""
    # At level l, what is left begins at lo = ceil(first / 2^l) and ends before hi = floor(end / 2^l): an odd lo and the
    # cell before an odd hi have no partner to make a larger cell with.
    lo, hi = "(-shiftright(-_lo, l))", "shiftright(_hi, l)"
    cells = F.expr(
        f"""flatten(transform(sequence(0, {levels}), l -> array(
              CASE WHEN {lo} < {hi} AND {lo} % 2 <> 0 THEN struct(l AS level, {lo} AS cell) END,
              CASE WHEN {lo} + abs({lo} % 2) < {hi} AND {hi} % 2 <> 0 THEN struct(l AS level, {hi} - 1 AS cell) END,
              CASE WHEN l = {levels} AND {lo} + abs({lo} % 2) < {hi} - abs({hi} % 2) THEN struct(l AS level, {lo} + abs({lo} % 2) AS cell) END)))"""
    )
    span = df.withColumns({"_lo": F.floor(F.col("a") / width).cast("bigint"), "_hi": F.floor(F.col("b") / width).cast("bigint") + 1})
    return span.withColumn("c", F.explode(F.filter(cells, lambda c: c.isNotNull()))).drop("_lo", "_hi").select("*", "c.level", "c.cell").drop("c")


def interval_overlaps(left: DataFrame, right: DataFrame, by: list[str], width: float) -> DataFrame:
    """(by, left_id, right_id, shared) of intervals (id, a, b) of one key that overlap.

    Of two that overlap, one begins inside the other. Each interval is covered by dyadic cells, some 2 log2(length /
    ``width``) rows however long it is, and each beginning asks for the cells above it, one a level, so every pair meets in
    one cell. ``width`` is the least cell; it changes no result, and should be about the length of the short ones."""
    sides = [df.where("a < b").select(*by, "id", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")) for df in (left, right)]
    longest = sides[0].select("a", "b").union(sides[1].select("a", "b")).agg(F.max((F.col("b") - F.col("a")) / width)).first()[0]
    levels = max(0, math.ceil(math.log2(longest + 2))) if longest else 0

    def within(points: DataFrame, covers: DataFrame, names: tuple[str, str], strict: bool) -> DataFrame:
        first = F.floor(F.col("a") / width).cast("bigint").alias("_p")
        asked = points.select(*by, F.col("id").alias(names[0]), F.col("a").alias("_a"), F.col("b").alias("_b"), first).withColumn("c", F.explode(F.expr(f"transform(sequence(0, {levels}), l -> struct(l AS level, shiftright(_p, l) AS cell))")))
        stood = _cover(covers.withColumnRenamed("id", names[1]), levels, width)
        met = asked.select("*", "c.level", "c.cell").drop("c", "_p").join(stood, [*by, "level", "cell"])
        inside = (F.col("_a") > F.col("a")) if strict else (F.col("_a") >= F.col("a"))
        return met.where(inside & (F.col("_a") < F.col("b"))).select(*by, "left_id", "right_id", (F.least("b", "_b") - F.col("_a")).alias("shared"))

    names = ("left_id", "right_id")
    return within(sides[0], sides[1], names, False).unionByName(within(sides[1], sides[0], names[::-1], True))


def merged_intervals(rows: DataFrame, by: list[str], gap: float = 0.0) -> DataFrame:
    """Islands of intervals (a, b), a <= b, by key: (by, a, b, n). Intervals of one start are one row first; what ends
    last before a start, and the islands' numbers, come from ranges of starts, so one key's intervals spread over tasks.
    Intervals without a start or end are left out."""
    starts = rows.where("a IS NOT NULL AND b IS NOT NULL").groupBy(*by, "a").agg(F.max("b").alias("b"), F.count("*").alias("n"))
    told = checkpointed(greatest_before(starts, by, "a", "b", "_before"))
    marked = told.withColumn("_island", F.when(F.col("_before").isNull() | (F.col("a") - F.col("_before") > gap), 1).otherwise(0))
    numbered_ = running_sums(marked, by, "a", ["_island"])
    return numbered_.groupBy(*by, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).drop("_island")


#: Assets in a part of a snapshot.
PART = 1 << 16


def snapshot_digest(assets: DataFrame) -> DataFrame:
    """(n_assets, digest) of a registry (id, created_at, sha256): a digest of the digests of parts of ``PART`` assets each,
    in the order of created_at and id. So no task gathers the registry, and the last one has a line a part."""
    placed = numbered(assets.select("created_at", "id", "sha256"), "created_at", "id").withColumn("part", F.floor((F.col("number") - 1) / PART))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "id", "sha256"))), lambda x: F.concat_ws(":", x["id"].cast("string"), x["sha256"])), "\n")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.sha2(lines, 256).alias("d"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "\n")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_assets"), F.sha2(ordered, 256).alias("digest"))


def bundle_violations(snapshot: DataFrame, manifests: DataFrame, artifacts: DataFrame, chain: DataFrame, checkpoint: DataFrame, receipt_digest: str, signed: DataFrame | None = None) -> DataFrame:
    """(rule, key) of every rule that a bundle breaks; none: it is whole.

    snapshot (asset_id, manifest_sha256, feature_sha256), manifests (asset_id, document), artifacts (digest, content),
    chain (log, seq, previous_hash, event_hash, body) of one log, checkpoint (log, sequence, head), and, where given,
    signed (name, message, public_key, signature)."""
    found = manifests.select("asset_id", F.sha2("document", 256).alias("d"))
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    both = snapshot.join(found, "asset_id", "full_outer")
    out = rule(both.where("d IS NULL"), "manifest_missing", "asset_id")
    out = out.union(rule(both.where("manifest_sha256 IS NULL"), "manifest_unexpected", "asset_id"))
    out = out.union(rule(both.where("d <> manifest_sha256"), "manifest_digest", "asset_id"))
    needed = snapshot.where("feature_sha256 IS NOT NULL").select("asset_id", F.col("feature_sha256").alias("digest"))
    out = out.union(rule(needed.join(artifacts.select("digest").distinct(), "digest", "left_anti"), "artifact_missing", "asset_id"))
    out = out.union(rule(damaged(artifacts), "artifact_digest", "digest"))
    out = out.union(rule(chain_violations(chain), "event_chain", "seq"))
    out = out.union(rule(log_status(chain, checkpoint).where("reason LIKE 'checkpoint%'"), "checkpoint", "reason"))
    has = chain.agg(F.coalesce(F.bool_or(F.col("body").contains(receipt_digest)), F.lit(False)).alias("has"))
    out = out.union(has.where("NOT has").select(F.lit("receipt_not_in_log").alias("rule"), F.lit(receipt_digest).alias("key")))
    if signed is not None:
        out = out.union(rule(signed.where(~verified(F.col("message"), F.col("public_key"), F.col("signature"))), "signature", "name"))
    return out


def claim_states(n_matches: Column, lineage: Column, authorized: Column, visual_review: Column, audio_review: Column) -> list[Column]:
    """The nine claims as separate states; none is promoted from another. Reviews may be null."""
    name = lambda k, c: c.alias(k)
    return [
        name("c1_exact_asset", F.when(n_matches > 1, "exact_registration_conflict").when(n_matches == 1, "exact_match").otherwise("no_exact_match")),
        name("c2_signed_lineage", F.when(lineage, "recorded").otherwise("absent")),
        name("c3_visual_derivation", F.coalesce(visual_review, F.lit("not_established"))),
        name("c4_audio_derivation", F.coalesce(audio_review, F.lit("not_established"))),
        name("c5_transcript_derivation", F.lit("not_evaluated")),
        name("c6_watermark_attribution", F.lit("not_evaluated")),
        name("c7_authorization", F.when(authorized, "valid_record").otherwise("unknown")),
        name("c8_publication", F.lit("not_evaluated")),
        name("c9_ownership", F.lit("not_determined")),
    ]
