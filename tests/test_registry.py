"""A candidate check from registration to the bundle that others verify."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from derivata.functions import signatures
from derivata.operators import evidence, registry
from derivata.shipping import ship

SEED, MARKS = bytes(range(32)), bytes(range(1, 33))
PEM, MARKS_PEM = (signatures.pem(signatures.public_key(s)) for s in (SEED, MARKS))
AT = "2026-03-01T00:00:00+00:00"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
NO_ASSETS = "asset_id string, sha256 string, filename string, size_bytes bigint, duration_s double, created_at string, features_sha256 string, fingerprint_status string, manifest string"
UPLOAD = "filename string, sha256 string, size_bytes bigint, duration_s double, assertion string, features_sha256 string"


def test_envelopes():
    document = signatures.envelope(SEED, {"b": 1, "a": "é"})
    assert signatures.sound(document) and signatures.sound(document, PEM) and not signatures.sound(document, MARKS_PEM)
    for spoilt in ({**document, "payload": {"b": 2}}, {**document, "signing_key_id": "0"}, {**document, "signature_algorithm": "x"}, {**document, "signature_base64": "!"}, {**document, "public_key_pem": 7}, {}, None, []):
        assert not signatures.sound(spoilt)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Writes a table and reads it back, so that plans stay small."""
    folder = tmp_path_factory.mktemp("registry")

    def put(df):
        path = f"file://{folder}/{len(list(folder.iterdir()))}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return put


@pytest.fixture(scope="module")
def world(spark, stored):
    """Two assets of the same bytes, another with features, an authorized child and an unauthorized one."""
    ship(spark)
    features = json.dumps({"media_sha256": sha("film"), "frames": [1]})
    artifacts = spark.createDataFrame([(sha(features), features)], "digest string, content string")
    first, _ = registry.register(spark.createDataFrame([("dir/a.mp4", sha("film"), 10, 8.0, " A ", sha(features))], UPLOAD), spark.createDataFrame([], NO_ASSETS), SEED, AT)
    first = stored(first)
    uploads = spark.createDataFrame([("b.mp4", sha("film"), 10, 8.0, "B", None), ("c.mp4", sha("other"), 10, 8.0, "C", None), ("d.mp4", sha("d"), 0, 8.0, "D", None), ("e.mp4", sha("e"), 10, 8.0, " ", None), ("f.mp4", "x", 10, 8.0, "F", None), ("g.mp4", sha("g"), 10, 4000.0, "G", None)], UPLOAD)
    second, refused = registry.register(uploads, first, SEED, AT)
    assets = stored(first.unionByName(second))
    parent = first.first().asset_id
    ask = "parent_id string, child_sha256 string, grantee string, valid_from string, valid_until string, scope_note string"
    auth, no_auth = registry.authorize(spark.createDataFrame([(parent, sha("child"), "E", "2026-01-01T00:00:00+01:00", "2026-04-01T00:00:00Z", "s"), ("nobody", sha("child"), "E", "2026-01-01T00:00:00Z", "2026-04-01T00:00:00Z", "s"), (parent, sha("child"), "E", "2026-05-01T00:00:00Z", "2026-04-01T00:00:00Z", "s"), (parent, sha("child"), " ", "2026-01-01T00:00:00Z", "2026-04-01T00:00:00Z", "s")], ask), assets, SEED, AT)
    auth = stored(auth)
    kind = "parent_id string, child_sha256 string, intervals array<struct<a: double, b: double>>, transformations array<string>, authorization_id string"
    own = auth.first().authorization_id
    derivatives, no_derivative = registry.derive(spark.createDataFrame([(parent, sha("child"), [(0.0, 4.0)], ["crop"], own), (parent, sha("free"), [(1.0, 2.0)], [], None), (parent, sha("free"), [(1.0, 9.0)], [], None), (parent, sha("free"), [(1.0, 2.0)], [], own), (parent, sha("free"), [], [], None)], kind), assets, auth, SEED, AT)
    return {"assets": assets, "artifacts": artifacts, "auth": auth, "derivatives": stored(derivatives), "refused": (refused, no_auth, no_derivative), "parent": parent}


def test_registration_names_conflicts_and_refuses(world):
    assets = {r.filename: json.loads(r.manifest)["payload"] for r in world["assets"].collect()}
    assert set(assets) == {"a.mp4", "b.mp4", "c.mp4"} and assets["a.mp4"]["registrant_assertion"] == "A"
    assert (assets["b.mp4"]["registration_conflicts"], assets["b.mp4"]["first_conflict"], assets["c.mp4"]["registration_conflicts"]) == (1, world["parent"], 0)
    refused, no_auth, no_derivative = ({r.reason for r in x.collect()} for x in world["refused"])
    assert refused == {"size", "no_assertion", "no_digest", "duration"} and no_auth == {"unknown_parent", "period", "no_grantee_or_scope"} and no_derivative == {"intervals", "authorization"}


def test_untrusted_assets_stop_a_check(world):
    spoilt = world["assets"].withColumn("sha256", F.when(F.col("filename") == "c.mp4", sha("x")).otherwise(F.col("sha256")))
    with pytest.raises(ValueError, match="not sound"):
        registry.trusted_assets(spoilt, PEM)
    with pytest.raises(ValueError, match="not sound"):
        registry.trusted_assets(world["assets"], MARKS_PEM)


def checked(spark, world, at=AT, reviews=None, **change):
    rows = [("k1", sha("film"), "x/film.mp4", None), ("k2", sha("child"), "child.mp4", None), ("k3", sha("free"), "free.mp4", None), ("k4", sha("new"), "new.mp4", None)]
    candidates = spark.createDataFrame(rows, "candidate_id string, sha256 string, filename string, features_sha256 string")
    leads = spark.createDataFrame([("k4", 0.9), ("k4", 0.8)], "candidate_id string, score double")
    w = {**world, **change}
    return registry.check(candidates, w["assets"], w["derivatives"], w["auth"], SEED, PEM, at, leads, reviews)


def states(df):
    return {r.candidate_id: (r.c1_exact_asset, r.c2_signed_lineage, r.c3_visual_derivation, r.c7_authorization, r.c9_ownership, r.n_leads) for r in df.collect()}


def test_claims_stay_apart(spark, world):
    none, at_all = "not_established", "not_determined"
    want = {"k1": ("exact_registration_conflict", "absent", none, "unknown", at_all, 0), "k2": ("no_exact_match", "recorded", none, "valid_record", at_all, 0), "k3": ("no_exact_match", "recorded", none, "unknown", at_all, 0), "k4": ("no_exact_match", "absent", none, "unknown", at_all, 2)}
    assert states(checked(spark, world)) == want
    for at, state in (("2025-12-31T23:00:00+00:00", "valid_record"), ("2025-12-31T22:59:59+00:00", "unknown"), ("2026-04-01T00:00:00+00:00", "valid_record"), ("2026-04-01T00:00:01+00:00", "unknown")):
        assert states(checked(spark, world, at))["k2"][3] == state
    assert states(checked(spark, world, auth=world["auth"].withColumn("revoked_at", F.lit(AT))))["k2"][1:4] == ("recorded", none, "unknown")
    longer = world["auth"].withColumn("valid_until", F.lit("2027-01-01T00:00:00+00:00"))  # the row says what the record does not
    assert states(checked(spark, world, auth=longer))["k2"][3] == "unknown"
    forged = world["derivatives"].withColumn("envelope", F.replace("envelope", F.lit("crop"), F.lit("crap")))
    assert states(checked(spark, world, derivatives=forged))["k2"][1] == "absent" and states(checked(spark, world, derivatives=forged))["k3"][1] == "recorded"
    reviews = spark.createDataFrame([("k4", "reviewed_support", "ambiguous")], "candidate_id string, visual_state string, audio_state string")
    assert states(checked(spark, world, reviews=reviews))["k4"][2] == "reviewed_support"


def test_bundles_show_every_damage(spark, world, stored):
    one = stored(checked(spark, world).where("candidate_id = 'k2'"))
    receipt = one.first().receipt
    events = spark.createDataFrame([("log", 1, "origin_registered|a|" + sha("m")), ("log", 2, "candidate_verified|k2|" + sha(receipt))], "log string, at int, body string")
    chain = stored(evidence.build_chain(events, "log", "at", "body"))
    marks = stored(evidence.checkpoints(chain, MARKS, AT))
    whole = {k: stored(v) for k, v in registry.bundle(one, world["assets"], world["artifacts"], world["derivatives"], world["auth"], chain, marks).items()}
    broken = lambda key=MARKS_PEM, **change: {r.rule for r in registry.check_bundle({**whole, **change}, PEM, key).collect()}
    spoil = lambda name, column, value: whole[name].withColumn(column, value)
    assert broken() == set()
    assert broken(PEM, artifacts=spoil("artifacts", "content", F.lit("{}")), derivatives=whole["derivatives"].where("false")) == {"artifact_digest", "feature_media", "lineage_missing", "checkpoint_signer"}
    previous = F.when(F.col("seq") == 2, "x").otherwise(F.col("previous_hash"))
    assert broken(artifacts=whole["artifacts"].where("false"), authorizations=spoil("authorizations", "envelope", F.lit("{}")), chain=chain.withColumn("previous_hash", previous)) == {"feature_missing", "authorization_record", "event_chain"}
    forged = whole["receipt"].withColumns({"receipt": F.replace("receipt", F.lit("recorded"), F.lit("absent")), "sha256": F.lit(sha("y"))})
    assert broken(receipt=forged, chain=chain.where("seq = 1")) >= {"receipt_signer", "candidate_bytes", "receipt_not_in_log", "checkpoint"}
    assert broken(manifests=whole["manifests"].where("asset_id <> '" + world["parent"] + "'"), checkpoint=spoil("checkpoint", "envelope", F.lit(None).cast("string"))) >= {"registry_snapshot", "derivative_record", "checkpoint", "checkpoint_signer"}


def test_listings(spark):
    rows = spark.createDataFrame([(f"k{i:03d}", "d", "f", f"2026-01-{1 + i % 28:02d}") for i in range(60)], "candidate_id string, sha256 string, filename string, created_at string")
    got = registry.newest(rows).collect()
    assert len(got) == 50 and [(r.created_at, r.candidate_id) for r in got[:3]] == [("2026-01-28", "k027"), ("2026-01-28", "k055"), ("2026-01-27", "k026")]
    assert [r.candidate_id for r in registry.listing(rows, "candidate_id", created_at="2026-01-01").collect()] == ["k000", "k028", "k056"]


def test_revoking_makes_one_event_and_names_unknown_ids(spark):
    known = spark.createDataFrame([("a", None), ("b", "2020"), ("c", None)], "authorization_id string, revoked_at string")
    after, events, unknown = evidence.revoke(known, spark.createDataFrame([("a", "2025"), ("a", "2024"), ("b", "2024"), ("x", "2024"), (None, "2024")], "authorization_id string, revoked_at string"))
    assert sorted(map(tuple, after.collect()), key=str) == [("a", "2024"), ("b", "2020"), ("c", None)]
    assert [tuple(r) for r in events.collect()] == [("authorization_revoked", "a", '{"revoked_at":"2024"}')] and [r[0] for r in unknown.collect()] == ["x"]


def test_artifacts_are_verified_when_read(spark):
    stored = spark.createDataFrame([(sha("x"), "x"), (sha("y"), "z")], "digest string, content string")
    ask = lambda *d: evidence.verified_artifacts(stored, spark.createDataFrame([(x,) for x in d], "digest string")).collect()
    assert [r.content for r in ask(sha("x"), sha("x"))] == ["x"]
    for digest, reason in ((sha("y"), "not the content"), (sha("n"), "no artifact")):
        with pytest.raises(Exception, match=reason):
            ask(digest)


def test_reviews_are_records_of_their_own(spark, world, stored):
    done = stored(checked(spark, world))
    kind = "candidate_id string, reviewer string, visual_state string, audio_state string, explanation string"
    asked = spark.createDataFrame([("k4", " R ", "reviewed_support", "ambiguous", "seen"), ("k9", "R", "insufficient", "insufficient", "x"), ("k1", "R", "proved", "insufficient", "x"), ("k2", "R", "insufficient", "insufficient", " "), ("k3", " ", "insufficient", "insufficient", "x")], kind)
    made, refused = registry.review(asked, done, SEED, AT)
    row = made.first()
    payload = json.loads(row.receipt)["payload"]
    assert made.count() == 1 and payload["reviewer_assertion"] == "R" and payload["candidate_sha256"] == sha("new") and signatures.sound(json.loads(row.receipt), PEM)
    assert payload["verification_receipt_sha256"] == sha(done.where("candidate_id = 'k4'").first().receipt)
    assert {(r.candidate_id, r.reason) for r in refused.collect()} == {("k9", "unknown_candidate"), ("k1", "state_or_explanation"), ("k2", "state_or_explanation"), ("k3", "no_reviewer")}
    assert states(checked(spark, world, reviews=made))["k4"][2] == "reviewed_support"
