"""The registry: registration, candidate checks with receipts, and what a check leaves behind for others to verify.

Every record is an envelope: a JSON document with the operator's signature. Rows say what records say, and a row that
disagrees with its record counts for nothing. Similarity, lineage, authorization and ownership are separate claims.

Tables: assets (asset_id, sha256, filename, size_bytes, duration_s, created_at, features_sha256, fingerprint_status,
manifest), authorizations (authorization_id, parent_id, child_sha256, valid_from, valid_until, envelope, revoked_at),
derivatives (derivative_id, parent_id, child_sha256, authorization_id, envelope), candidates (candidate_id, sha256,
filename, size_bytes, created_at, features_sha256, receipt) and reviews (review_id, candidate_id, receipt). Times are ISO
8601 texts with an offset."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import base_name, digest_column, is_digest, stamp
from ..functions.ordinals import checkpointed
from ..functions.signatures import signed, sound, sound_column
from . import tree
from .evidence import claim_states, damaged, snapshot_digest
from .retrieval import exact_matches

SCHEMA = "derivata-record-v1"
MOST_BYTES = 512 << 20
KEEP_NULLS = {"ignoreNullFields": "false"}


def said(envelope: str | Column, name: str) -> Column:
    """A field of an envelope's payload, as text."""
    return F.get_json_object(envelope, f"$.payload.{name}")


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt evenly to as many tasks as a shuffle has: signing and verifying take time by rows, not by bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _payload(kind: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit(kind).alias("document_type"), *[c.alias(k) for k, c in fields.items()]), KEEP_NULLS)


def _id(prefix: str, *parts: str) -> Column:
    """An id that follows from what is recorded, so that a repeated job gives the same."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.to_json(F.struct(*parts), KEEP_NULLS), 256), 1, 32))


def register(uploads: DataFrame, assets: DataFrame, seed: bytes, at: str) -> tuple[DataFrame, DataFrame]:
    """New assets, and refused uploads with a reason, from (filename, sha256, size_bytes, duration_s, assertion,
    features_sha256). The manifest has the number of assets of the same bytes that were registered before, and the least
    of their ids; all of them are the rows of one digest."""
    rows = uploads.withColumn("filename", base_name(F.col("filename"))).withColumn("assertion", F.trim("assertion"))
    reason = (
        F.when(F.coalesce(F.col("assertion"), F.lit("")) == "", "no_assertion")
        .when(~is_digest(F.col("sha256")), "no_digest")
        .when(~F.coalesce((F.col("size_bytes") > 0) & (F.col("size_bytes") <= MOST_BYTES), F.lit(False)), "size")
        .when(~F.coalesce((F.col("duration_s") > 0) & (F.col("duration_s") <= 3600), F.lit(False)), "duration")
    )
    judged = rows.withColumn("reason", reason)
    same = assets.groupBy("sha256").agg(F.count("*").alias("n_conflicts"), F.min("asset_id").alias("first_conflict"))
    fresh = judged.where("reason IS NULL").drop("reason").dropDuplicates(["sha256", "filename", "assertion"])
    fresh = fresh.join(same, "sha256", "left").withColumns({"created_at": F.lit(at), "asset_id": _id("asset", "sha256", "filename", "assertion"), "fingerprint_status": F.when(F.col("features_sha256").isNull(), "not_indexed").otherwise("indexed")})
    fields = {c: F.col(c) for c in ("asset_id", "duration_s", "fingerprint_status", "first_conflict")}
    payload = _payload("origin_manifest", exact_media_sha256=F.col("sha256"), media_size_bytes=F.col("size_bytes"), original_filename=F.col("filename"), registrant_assertion=F.col("assertion"), registered_at=F.col("created_at"), feature_artifact_sha256=F.col("features_sha256"), registration_conflicts=F.coalesce("n_conflicts", F.lit(0)), claim_scope=F.lit("These bytes were registered with an assertion of origin; creation and ownership are not established."), **fields)
    made = _dealt(fresh.join(assets.select("asset_id"), "asset_id", "left_anti"), "asset_id").withColumn("manifest", signed(payload, seed))
    return made.select("asset_id", "sha256", "filename", "size_bytes", "duration_s", "created_at", "features_sha256", "fingerprint_status", "manifest"), judged.where("reason IS NOT NULL")


def untrusted(assets: DataFrame, trusted: str) -> DataFrame:
    """asset_id of the assets whose manifest is not the trusted signer's, or says something else than their row."""
    agrees = said("manifest", "asset_id").eqNullSafe(F.col("asset_id")) & said("manifest", "exact_media_sha256").eqNullSafe(F.col("sha256")) & said("manifest", "feature_artifact_sha256").eqNullSafe(F.col("features_sha256"))
    return assets.where(~(sound_column(F.col("manifest"), trusted) & agrees)).select("asset_id")


def trusted_assets(assets: DataFrame, trusted: str) -> DataFrame:
    """``assets``, refused as a whole if one of them is untrusted."""
    if found := untrusted(assets, trusted).limit(1).collect():
        raise ValueError(f"the manifest of a registered asset is not sound: {found[0].asset_id}")
    return assets


def authorize(requests: DataFrame, assets: DataFrame, seed: bytes, at: str) -> tuple[DataFrame, DataFrame]:
    """New authorizations, and refused requests with a reason, from (parent_id, child_sha256, grantee, valid_from,
    valid_until, scope_note)."""
    known = requests.join(assets.select(F.col("asset_id").alias("parent_id"), F.lit(True).alias("_known")), "parent_id", "left")
    begin, end = stamp(F.col("valid_from")), stamp(F.col("valid_until"))
    said_ = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    reason = (
        F.when(F.col("_known").isNull(), "unknown_parent").when(~is_digest(F.col("child_sha256")), "no_digest").when(~F.coalesce(end > begin, F.lit(False)), "period").when(~(said_(F.col("grantee")) & said_(F.col("scope_note"))), "no_grantee_or_scope")
    )
    judged = known.withColumn("reason", reason).drop("_known")
    utc = lambda c: F.date_format(F.to_utc_timestamp(c, F.expr("current_timezone()")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    good = judged.where("reason IS NULL").drop("reason").withColumns({"valid_from": utc(begin), "valid_until": utc(end)})
    good = good.withColumn("authorization_id", _id("auth", "parent_id", "child_sha256", "grantee", "valid_from", "valid_until", "scope_note")).dropDuplicates(["authorization_id"])
    payload = _payload("authorization_record", authorization_id=F.col("authorization_id"), parent_asset_id=F.col("parent_id"), child_sha256=F.col("child_sha256"), grantee_assertion=F.trim("grantee"), valid_from=F.col("valid_from"), valid_until=F.col("valid_until"), scope_note=F.trim("scope_note"), signed_at=F.lit(at))
    out = _dealt(good, "authorization_id").withColumns({"envelope": signed(payload, seed), "revoked_at": F.lit(None).cast("string")})
    return out.select("authorization_id", "parent_id", "child_sha256", "valid_from", "valid_until", "envelope", "revoked_at"), judged.where("reason IS NOT NULL")


def derive(requests: DataFrame, assets: DataFrame, authorizations: DataFrame, seed: bytes, at: str) -> tuple[DataFrame, DataFrame]:
    """New derivative records, and refused requests with a reason, from (parent_id, child_sha256, intervals array<struct<a,
    b>>, transformations array<string>, authorization_id)."""
    parent = assets.select(F.col("asset_id").alias("parent_id"), "duration_s", digest_column(F.col("manifest")).alias("parent_manifest_sha256"))
    cover = authorizations.select("authorization_id", F.col("parent_id").alias("_p"), F.col("child_sha256").alias("_c"))
    both = requests.join(parent, "parent_id", "left").join(cover, "authorization_id", "left")
    inside = F.coalesce((F.size("intervals") > 0) & F.forall("intervals", lambda x: ~F.isnan(x["a"]) & ~F.isnan(x["b"]) & (x["a"] >= 0) & (x["a"] < x["b"]) & (x["b"] <= F.col("duration_s"))), F.lit(False))
    covered = F.col("authorization_id").isNull() | (F.col("_p").eqNullSafe(F.col("parent_id")) & F.col("_c").eqNullSafe(F.col("child_sha256")))
    reason = F.when(F.col("parent_manifest_sha256").isNull(), "unknown_parent").when(~is_digest(F.col("child_sha256")), "no_digest").when(~inside, "intervals").when(~covered, "authorization")
    judged = both.withColumn("reason", reason)
    good = judged.where("reason IS NULL").withColumn("derivative_id", _id("derivative", "parent_id", "child_sha256", "intervals", "transformations", "authorization_id")).dropDuplicates(["derivative_id"])
    pairs = F.transform("intervals", lambda x: F.array(x["a"], x["b"]))
    payload = _payload("derivative_manifest", derivative_id=F.col("derivative_id"), parent_asset_id=F.col("parent_id"), parent_manifest_sha256=F.col("parent_manifest_sha256"), child_sha256=F.col("child_sha256"), declared_source_intervals_s=pairs, declared_transformations=F.col("transformations"), authorization_id=F.col("authorization_id"), signed_at=F.lit(at))
    out = _dealt(good, "derivative_id").withColumn("envelope", signed(payload, seed))
    return out.select("derivative_id", "parent_id", "child_sha256", "authorization_id", "envelope"), judged.where("reason IS NOT NULL").select(*requests.columns, "reason")


def review(decisions: DataFrame, checked: DataFrame, seed: bytes, at: str) -> tuple[DataFrame, DataFrame]:
    """New review records, and refused decisions with a reason, from (candidate_id, reviewer, visual_state, audio_state,
    explanation). A record names the digest of the receipt that was reviewed; it changes no other claim."""
    from ..plans.methods import valid_review

    known = decisions.join(checked.select("candidate_id", F.col("sha256").alias("_media"), digest_column(F.col("receipt")).alias("_receipt")), "candidate_id", "left")
    states = valid_review(F.col("visual_state"), F.col("explanation")) & valid_review(F.col("audio_state"), F.col("explanation"))
    reason = F.when(F.col("_receipt").isNull(), "unknown_candidate").when(~states, "state_or_explanation").when(F.coalesce(F.trim("reviewer"), F.lit("")) == "", "no_reviewer")
    judged = known.withColumn("reason", reason)
    good = judged.where("reason IS NULL").withColumn("review_id", _id("review", "candidate_id", "reviewer", "visual_state", "audio_state", "explanation", "_receipt")).dropDuplicates(["review_id"])
    payload = _payload("review_receipt", review_id=F.col("review_id"), candidate_id=F.col("candidate_id"), candidate_sha256=F.col("_media"), verification_receipt_sha256=F.col("_receipt"), reviewer_assertion=F.trim("reviewer"), visual_state=F.col("visual_state"), audio_state=F.col("audio_state"), explanation=F.trim("explanation"), reviewed_at=F.lit(at))
    out = good.withColumn("receipt", signed(payload, seed))
    return out.select("review_id", "candidate_id", "visual_state", "audio_state", "receipt"), judged.where("reason IS NOT NULL").select(*decisions.columns, "reason")


def lineage_records(children: DataFrame, derivatives: DataFrame, assets: DataFrame, authorizations: DataFrame, trusted: str, at: str) -> DataFrame:
    """(child_sha256, derivative_id, parent_id, manifest_sha256, authorization_id, record_sha256) of the sound derivations
    of each child. The record must name child, parent and the digest of the parent's manifest as it is; authorization_id
    is null unless a sound one that is not revoked names both, agrees with its row and holds at the time, ends included."""
    parent = assets.where(sound_column(F.col("manifest"), trusted)).select(F.col("asset_id").alias("parent_id"), digest_column(F.col("manifest")).alias("_digest"))
    d = derivatives.join(children.select("child_sha256").distinct(), "child_sha256").where(sound_column(F.col("envelope"), trusted)).join(parent, "parent_id")
    agrees = said("envelope", "child_sha256").eqNullSafe(F.col("child_sha256")) & said("envelope", "parent_asset_id").eqNullSafe(F.col("parent_id")) & said("envelope", "parent_manifest_sha256").eqNullSafe(F.col("_digest"))
    d = d.where(agrees).select("child_sha256", "derivative_id", "parent_id", digest_column(F.col("envelope")).alias("manifest_sha256"), F.col("authorization_id").alias("claimed"))
    now = stamp(F.lit(at))
    a = authorizations.where("revoked_at IS NULL").where(now.between(stamp(F.col("valid_from")), stamp(F.col("valid_until")))).where(sound_column(F.col("envelope"), trusted))
    for name, column in (("authorization_id",) * 2, ("parent_asset_id", "parent_id"), ("child_sha256",) * 2, ("valid_from",) * 2, ("valid_until",) * 2):
        a = a.where(said("envelope", name).eqNullSafe(F.col(column)))
    a = a.select("child_sha256", "parent_id", F.col("authorization_id").alias("claimed"), F.col("authorization_id").alias("_a"), digest_column(F.col("envelope")).alias("record_sha256"))
    return d.join(a, ["child_sha256", "parent_id", "claimed"], "left").select("child_sha256", "derivative_id", "parent_id", "manifest_sha256", F.col("_a").alias("authorization_id"), "record_sha256")


def claims(candidates: DataFrame, assets: DataFrame, records: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """(candidate_id, sha256, n_exact, first_exact, n_lineage, n_authorized and the nine claims) of each candidate
    (candidate_id, sha256), by exact registration, :func:`lineage_records`, and reviews (candidate_id, visual_state,
    audio_state) where given."""
    exact = exact_matches(candidates.select(F.col("candidate_id").alias("id"), "sha256"), assets.select(F.col("asset_id").alias("id"), "sha256")).toDF("candidate_id", "n_exact", "first_exact")
    linked = records.groupBy(F.col("child_sha256").alias("sha256")).agg(F.count("*").alias("n_lineage"), F.count("authorization_id").alias("n_authorized"))
    out = candidates.select("candidate_id", "sha256").join(exact, "candidate_id", "left").join(linked, "sha256", "left").fillna(0, ["n_exact", "n_lineage", "n_authorized"])
    none = F.lit(None).cast("string")
    seen = reviews.select("candidate_id", "visual_state", "audio_state") if reviews is not None else candidates.select("candidate_id", none.alias("visual_state"), none.alias("audio_state")).where("false")
    out = out.join(seen, "candidate_id", "left")
    states = claim_states(F.col("n_exact"), F.col("n_lineage") > 0, F.col("n_authorized") > 0, F.col("visual_state"), F.col("audio_state"))
    return out.select("candidate_id", "sha256", "n_exact", "first_exact", "n_lineage", "n_authorized", *states)


CLAIMS = ("c1_exact_asset", "c2_signed_lineage", "c3_visual_derivation", "c4_audio_derivation", "c5_transcript_derivation", "c6_watermark_attribution", "c7_authorization", "c8_publication", "c9_ownership")


def check(candidates: DataFrame, assets: DataFrame, derivatives: DataFrame, authorizations: DataFrame, seed: bytes, trusted: str, at: str, leads: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """``candidates`` (candidate_id, sha256, filename, features_sha256) with their claims, n_leads and a signed receipt.

    A receipt binds the claims to a snapshot of the registry. leads (candidate_id, ...) are counted; they never change a
    claim. An exact candidate needs no features, so callers look for leads of the others only."""
    known = trusted_assets(assets, trusted)
    records = lineage_records(candidates.select(F.col("sha256").alias("child_sha256")), derivatives, known, authorizations, trusted, at)
    stated = claims(candidates, known, records, reviews)
    snapshot = snapshot_digest(known.select(F.col("asset_id").alias("id"), "created_at", digest_column(F.col("manifest")).alias("sha256"))).first()
    n_leads = leads.groupBy("candidate_id").agg(F.count("*").alias("n_leads")) if leads is not None else candidates.select("candidate_id", F.lit(0).cast("bigint").alias("n_leads")).where("false")
    rows = candidates.join(stated.drop("sha256"), "candidate_id").join(n_leads, "candidate_id", "left").fillna(0, ["n_leads"])
    payload = _payload("verification_receipt", candidate_id=F.col("candidate_id"), candidate_sha256=F.col("sha256"), candidate_filename=base_name(F.col("filename")), checked_at=F.lit(at), registry_count=F.lit(snapshot.n_assets), registry_sha256=F.lit(snapshot.digest), feature_artifact_sha256=F.col("features_sha256"), n_exact=F.col("n_exact"), first_exact=F.col("first_exact"), n_lineage=F.col("n_lineage"), n_authorized=F.col("n_authorized"), claims=F.struct(*CLAIMS), n_review_leads=F.col("n_leads"))
    return rows.withColumn("receipt", signed(payload, seed))


def tree_leaves(assets: DataFrame) -> DataFrame:
    """(id, digest): the leaves of the registry's tree, the digests of the manifests."""
    return assets.select(F.col("asset_id").alias("id"), digest_column(F.col("manifest")).alias("digest"))


def tree_head(nodes: DataFrame, depth: int, seed: bytes, at: str) -> DataFrame:
    """One row (n_assets, root, envelope): the signed root of the registry's tree."""
    payload = _payload("registry_head", n_assets=F.col("n_assets"), root=F.col("root"), depth=F.lit(depth), signed_at=F.lit(at))
    return tree.root(nodes).withColumn("envelope", signed(payload, seed))


def proven_assets(assets: DataFrame, wanted: DataFrame, nodes: DataFrame, leaves: DataFrame, head: str, trusted: str) -> DataFrame:
    """The ``wanted`` (asset_id) assets with the path that proves each; an error if the signed ``head`` or one of their
    manifests is not the trusted signer's, if a row disagrees with its manifest, or if a manifest is not the registered one.
    Only these records are verified, and only their paths are read: ``leaves`` is the table of digests that stands."""
    if not sound(json.loads(head), trusted):
        raise ValueError("the head of the registry is not sound")
    said_ = json.loads(head)["payload"]
    mine = assets.join(wanted.select("asset_id").distinct(), "asset_id", "left_semi")
    found = tree.proofs(nodes, leaves, mine.select(F.col("asset_id").alias("id")), said_["depth"]).select(F.col("id").alias("asset_id"), "digest", "path")
    rows = mine.withColumn("_now", digest_column(F.col("manifest"))).join(found, "asset_id", "left")
    proves = F.col("digest").eqNullSafe(F.col("_now")) & tree.names_place(F.col("asset_id"), F.col("path")) & tree.proven_root(F.col("digest"), F.col("path")).eqNullSafe(F.lit(said_["root"]))
    bad = untrusted(mine, trusted).withColumn("_bad", F.lit(True))
    judged = rows.join(bad, "asset_id", "left")
    name = lambda why: F.raise_error(F.concat(F.lit(why), F.col("asset_id"))).cast("boolean")
    good = F.when(F.col("_bad").isNotNull(), name("the manifest of a registered asset is not sound: ")).when(~F.coalesce(proves, F.lit(False)), name("not the registered manifest: ")).otherwise(True)
    return judged.where(good).drop("_now", "_bad")


def check_by_proofs(candidates: DataFrame, assets: DataFrame, nodes: DataFrame, leaves: DataFrame, head: str, derivatives: DataFrame, authorizations: DataFrame, seed: bytes, trusted: str, at: str, reviews: DataFrame | None = None) -> DataFrame:
    """As :func:`check`, but bound to the signed head of the registry's tree: of all assets, only those of a candidate's
    bytes and the parents of its derivations are verified, each by its manifest and its path, and the receipt has these
    proofs. Receipts of assets that are not there are no proofs of absence."""
    same = assets.join(candidates.select("sha256").distinct(), "sha256", "left_semi").select("asset_id")
    parents = derivatives.join(candidates.select(F.col("sha256").alias("child_sha256")).distinct(), "child_sha256", "left_semi").select(F.col("parent_id").alias("asset_id"))
    known = checkpointed(proven_assets(assets, same.union(parents), nodes, leaves, head, trusted))
    records = lineage_records(candidates.select(F.col("sha256").alias("child_sha256")), derivatives, known, authorizations, trusted, at)
    stated = claims(candidates, known, records, reviews)
    # A candidate's proofs: of the least asset of its bytes, and of the least parent; all of one digest say the same.
    proof = F.struct(F.col("asset_id"), F.col("digest"), F.col("path"))
    exact = known.groupBy("sha256").agg(F.min(proof).alias("exact_proof"))
    of = records.select(F.col("child_sha256").alias("sha256"), F.col("parent_id").alias("asset_id")).join(known.select("asset_id", "digest", "path"), "asset_id").groupBy("sha256").agg(F.min(proof).alias("parent_proof"))
    # Dealt before the proofs make rows long.
    rows = _dealt(candidates.join(stated.drop("sha256"), "candidate_id"), "candidate_id").join(exact, "sha256", "left").join(of, "sha256", "left")
    signed_head = json.loads(head)["payload"]
    payload = _payload("verification_receipt", candidate_id=F.col("candidate_id"), candidate_sha256=F.col("sha256"), candidate_filename=base_name(F.col("filename")), checked_at=F.lit(at), registry_count=F.lit(signed_head["n_assets"]), registry_root=F.lit(signed_head["root"]), feature_artifact_sha256=F.col("features_sha256"), n_exact=F.col("n_exact"), first_exact=F.col("first_exact"), n_lineage=F.col("n_lineage"), n_authorized=F.col("n_authorized"), claims=F.struct(*CLAIMS), proofs=F.struct("exact_proof", "parent_proof"))
    return rows.withColumn("receipt", signed(payload, seed)).select(*candidates.columns, "n_exact", "first_exact", "n_lineage", "n_authorized", *CLAIMS, "receipt")


def unproven(receipt: str, trusted: str) -> Column:
    """Whether a receipt is not the trusted signer's, or has a proof that does not give the root it names, or an exact match
    or a derivation without one. Needs no registry, and no other row."""
    kind = "struct<asset_id: string, digest: string, path: array<string>>"
    both = F.from_json(F.get_json_object(receipt, "$.payload.proofs"), f"exact_proof {kind}, parent_proof {kind}")
    top = said(receipt, "registry_root")
    holds = lambda p: F.coalesce(tree.names_place(p["asset_id"], p["path"]) & (tree.proven_root(p["digest"], p["path"]) == top), F.lit(False))
    needed = lambda n: F.coalesce(said(receipt, n).try_cast("bigint"), F.lit(0)) > 0
    return ~sound_column(F.col(receipt), trusted) | (needed("n_exact") & ~holds(both["exact_proof"])) | (needed("n_lineage") & ~holds(both["parent_proof"]))


def unproven_receipts(checked: DataFrame, trusted: str) -> DataFrame:
    """candidate_id of the receipts that are :func:`unproven`."""
    return checked.where(unproven("receipt", trusted)).select("candidate_id")


def bundle(candidate: DataFrame, assets: DataFrame, artifacts: DataFrame, derivatives: DataFrame, authorizations: DataFrame, chain: DataFrame, marks: DataFrame) -> dict[str, DataFrame]:
    """What another party needs to verify one checked candidate (a row of :func:`check`), as tables: the receipt, all
    manifests of the snapshot, the artifacts that they and the candidate name, the candidate's derivatives and their
    authorizations, the log, and its last checkpoint."""
    mine = derivatives.join(candidate.select(F.col("sha256").alias("child_sha256")), "child_sha256", "left_semi")
    needed = assets.select("features_sha256").union(candidate.select("features_sha256")).where("features_sha256 IS NOT NULL").distinct()
    return {
        "receipt": candidate.select("candidate_id", "sha256", "features_sha256", "receipt"),
        "manifests": assets.select("asset_id", "created_at", "manifest"),
        "artifacts": artifacts.join(needed.withColumnRenamed("features_sha256", "digest"), "digest", "left_semi"),
        "derivatives": mine.select("derivative_id", "envelope"),
        "authorizations": authorizations.join(mine.select("authorization_id"), "authorization_id", "left_semi").select("authorization_id", "envelope"),
        "chain": chain,
        "checkpoint": marks.groupBy("log").agg(F.max_by("envelope", "seq").alias("envelope"), F.max("seq").alias("seq")),
    }


def check_bundle(parts: dict[str, DataFrame], trusted: str, trusted_checkpoint: str | None = None) -> DataFrame:
    """(rule, key) of every rule that a :func:`bundle` breaks; none: its signed data are whole. That says nothing of
    whether findings are true."""
    from .evidence import chain_violations

    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    receipt, artifacts = parts["receipt"], parts["artifacts"]
    # All that the rules ask of the manifests, once.
    facts = [said("manifest", n).alias(n) for n in ("asset_id", "exact_media_sha256", "feature_artifact_sha256")]
    read = _dealt(parts["manifests"], "asset_id").select(F.col("asset_id").alias("id"), "created_at", *facts, digest_column(F.col("manifest")).alias("sha256"), sound_column(F.col("manifest"), trusted).alias("sound"))
    manifests = checkpointed(read)
    out = [rule(receipt.where(~sound_column(F.col("receipt"), trusted)), "receipt_signer", "candidate_id")]
    out.append(rule(receipt.where(~said("receipt", "candidate_sha256").eqNullSafe(F.col("sha256"))), "candidate_bytes", "candidate_id"))
    out.append(rule(manifests.where("NOT sound"), "manifest_signer", "id"))
    out.append(rule(manifests.where(~F.col("asset_id").eqNullSafe(F.col("id"))), "manifest_identity", "id"))
    snapshot = snapshot_digest(manifests.select("id", "created_at", "sha256"))
    bound = receipt.crossJoin(snapshot)  # one row each
    out.append(rule(bound.where(~(said("receipt", "registry_sha256").eqNullSafe(F.col("digest")) & said("receipt", "registry_count").try_cast("bigint").eqNullSafe(F.col("n_assets")))), "registry_snapshot", "candidate_id"))
    # Features: there, unspoilt, and of the media that their owner names.
    owners = manifests.select(F.col("feature_artifact_sha256").alias("digest"), F.col("exact_media_sha256").alias("media"), F.col("id").alias("owner")).union(receipt.select("features_sha256", "sha256", "candidate_id")).where("digest IS NOT NULL")
    held = owners.join(artifacts.select("digest", F.get_json_object("content", "$.media_sha256").alias("of"), F.lit(True).alias("there")), "digest", "left")
    out += [rule(held.where("there IS NULL"), "feature_missing", "owner"), rule(held.where(F.col("there").isNotNull() & ~F.col("of").eqNullSafe(F.col("media"))), "feature_media", "owner"), rule(damaged(artifacts), "artifact_digest", "digest")]
    # The first claim again, from the manifests.
    exact = manifests.select(F.col("exact_media_sha256").alias("sha256"), "id").join(receipt.select("sha256", "candidate_id"), "sha256").groupBy("candidate_id").agg(F.countDistinct("id").alias("n"))
    again = receipt.join(exact, "candidate_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("n") > 1, "exact_registration_conflict").when(F.col("n") == 1, "exact_match").otherwise("no_exact_match")
    out.append(rule(again.where(~(said("receipt", "claims.c1_exact_asset").eqNullSafe(state) & said("receipt", "n_exact").try_cast("bigint").eqNullSafe(F.col("n")))), "exact_claim", "candidate_id"))
    # Records of lineage and authorization, and as many as the receipt has.
    named = receipt.select(F.col("sha256").alias("_child")).limit(1)
    owned = manifests.select(F.col("id").alias("_parent"), F.col("sha256").alias("_digest"))
    d = parts["derivatives"].crossJoin(named).withColumn("_parent", said("envelope", "parent_asset_id")).join(owned, "_parent", "left")
    good = sound_column(F.col("envelope"), trusted) & said("envelope", "child_sha256").eqNullSafe(F.col("_child")) & F.coalesce(said("envelope", "parent_manifest_sha256") == F.col("_digest"), F.lit(False))
    out.append(rule(d.where(~good), "derivative_record", "derivative_id"))
    a = parts["authorizations"].crossJoin(named)
    out.append(rule(a.where(~(sound_column(F.col("envelope"), trusted) & said("envelope", "child_sha256").eqNullSafe(F.col("_child")))), "authorization_record", "authorization_id"))
    counts = receipt.crossJoin(parts["derivatives"].agg(F.count("*").alias("n_d")))
    out.append(rule(counts.where(said("receipt", "n_lineage").try_cast("bigint") > F.col("n_d")), "lineage_missing", "candidate_id"))
    # The log, the receipt in it, and the checkpoint over it.
    chain, mark = parts["chain"], parts["checkpoint"]
    out.append(rule(chain_violations(chain), "event_chain", "seq"))
    inside = receipt.select("candidate_id", digest_column(F.col("receipt")).alias("r")).join(chain.select(F.regexp_extract("body", r"([0-9a-f]{64})$", 1).alias("r")).distinct(), "r", "left_anti")
    out.append(rule(inside, "receipt_not_in_log", "candidate_id"))
    head = chain.groupBy("log").agg(F.max("seq").alias("n"), F.max_by("event_hash", "seq").alias("head"))
    over = head.join(mark, "log", "left")
    binds = said("envelope", "sequence").try_cast("bigint").eqNullSafe(F.col("n")) & said("envelope", "log_head_sha256").eqNullSafe(F.col("head"))
    out += [rule(over.where(~sound_column(F.col("envelope"), trusted_checkpoint)), "checkpoint_signer", "log"), rule(over.where(~binds), "checkpoint", "log")]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def newest(candidates: DataFrame, most: int = 50) -> DataFrame:
    """The newest candidates' id, sha256, filename and created_at, ties by id: a listing of a stated length."""
    return candidates.select("candidate_id", "sha256", "filename", "created_at").orderBy(F.desc("created_at"), "candidate_id").limit(most)


def listing(rows: DataFrame, *order: str, **equal) -> DataFrame:
    """Rows of a table whose columns have given values, in an order."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.orderBy(*order)
