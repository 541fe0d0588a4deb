import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from derivata.functions.signatures import public_key, sign
from derivata.operators import accounting, alignment, calibration, decisions, evidence, partitioning, retrieval
from derivata.operators.design import design
from derivata.shipping import ship

ROW = "candidate_id string, method string, row_status string, status string, score double, margin double, top_parent string, expected_parent string, identity string, length_s int, observed_duration_s int, severity string, visual_ancestry boolean, audio_ancestry boolean"


def rows(spark, *changes):
    base = {"candidate_id": "c", "method": "V-C", "row_status": "evaluated", "status": "evaluated", "score": 0.9, "margin": 0.2, "top_parent": "S1", "expected_parent": "S1", "identity": "S1", "length_s": 5, "observed_duration_s": None, "severity": "moderate", "visual_ancestry": True, "audio_ancestry": True}
    return spark.createDataFrame([tuple({**base, "candidate_id": f"c{i}", **c}.values()) for i, c in enumerate(changes)], ROW)


def test_decision_priority(spark):
    df = rows(spark, {}, {"length_s": 2}, {"margin": 0.01}, {"margin": None}, {"score": None, "status": "failed"}, {"score": 0.5}, {"observed_duration_s": 4})
    got = df.orderBy("candidate_id").select(decisions.decision(F.lit(0.8), F.lit(5)).alias("d")).collect()
    assert [(r.d.state, r.d.reason) for r in got] == [("supported", "qualified_score_and_margin"), ("insufficient", "duration_or_score"), ("AMBIGUOUS", "competing_registered_parents"), ("supported", "qualified_score_and_margin"), ("insufficient", "unavailable_evidence"), ("insufficient", "duration_or_score"), ("insufficient", "duration_or_score")]
    assert got[4].d.processing_state == "failed" and got[0].d.parent == "S1" and got[2].d.parent is None
    none = rows(spark, {}).select(decisions.decision(F.lit(None).cast("double"), F.lit(5)).alias("d")).first()
    assert none.d.reason == "no_qualified_operating_point"


def test_curve_counts_right_parents_only(spark):
    curve = calibration.operating_curve(rows(spark, {"top_parent": "WRONG"}, {"identity": "N1", "score": 0.1, "visual_ancestry": False, "expected_parent": None}))
    at5 = curve.where("minimum_duration_s = 5").collect()
    assert len(at5) == 4 and all(r.tp_correct_parent == 0 for r in at5) and any(r.wrong_parent == 1 for r in at5)


def test_curve_with_failed_negative_and_harsh_rows(spark):
    df = rows(spark, {"identity": "N1", "visual_ancestry": False, "score": None, "status": "failed"}, {"severity": "harsh"}, {"severity": "harsh", "method": "A-x"})
    got = {(r.method, r.minimum_duration_s, r.threshold): r for r in calibration.operating_curve(df).collect()}
    v = got["V-C", 5, -0.000001]
    assert (v.negative_available_denominator, v.negative_expected_denominator, v.fpr, v.positive_denominator) == (0, 1, None, 0)
    assert got["A-x", 5, 0.9].positive_denominator == 1


def test_operating_point_prefers_short_then_best(spark):
    point = lambda d, t, tpr, fpr: ("V-C", d, t, 1, 1, tpr, fpr)
    curve = spark.createDataFrame([point(5, 0.1, 0.6, 0.0), point(10, 0.2, 0.8, 0.01), point(10, 0.3, 0.8, 0.01), point(10, 0.4, 0.75, 0.0), point(15, 0.2, 1.0, 0.0)], "method string, minimum_duration_s int, threshold double, negative_available_denominator int, negative_expected_denominator int, tpr double, fpr double")
    r = calibration.operating_points(curve).collect()
    assert [(x.minimum_duration_s, x.threshold) for x in r] == [(10, 0.3)]
    assert calibration.chosen_method(calibration.operating_points(curve)).first().method == "V-C"


def test_threshold_rules(spark):
    samples = spark.createDataFrame([("v", 0.9, True)] * 10 + [("v", 0.1, False)] * 10, "modality string, score double, is_positive boolean")
    curve = calibration.threshold_curve(samples, ["modality"])
    assert curve.count() == 21  # two distinct scores: the grid alone
    assert calibration.select_threshold(curve, ["modality"], "max_f1").first().threshold == pytest.approx(0.15)
    # An exact zero counts as the worst rate in the compatible mode; ties go to the lowest threshold.
    assert calibration.select_threshold(curve, ["modality"]).first().threshold == pytest.approx(0.15)
    with pytest.raises(ValueError):
        calibration.select_threshold(curve, ["modality"], "other")
    empty = samples.where(F.lit(False))
    assert calibration.threshold_curve(empty, ["modality"]).collect() == [] and calibration.distributions(empty, ["modality"]).collect() == []


def test_held_out_fusion_leaves_identities_out(spark):
    changes = [{"identity": f"S{i}", "expected_parent": f"S{i}", "top_parent": f"S{i}", "method": "F-fusion", "score": 0.9} for i in range(6)]
    changes += [{"identity": f"N{i}", "expected_parent": None, "visual_ancestry": False, "audio_ancestry": False, "method": "F-fusion", "score": 0.2} for i in range(4)]
    df = rows(spark, *changes).withColumn("weight", F.lit(0.5))
    r = calibration.held_out_fusion(df, 5).first()
    assert (r.held_out_tp, r.held_out_positive, r.held_out_fp, r.held_out_negative, r.qualified) == (6, 6, 0, 4, True)


def test_fused_pairs(spark):
    v = spark.createDataFrame([("c", "a", 1.0), ("c", "b", 0.0), ("c", "x", None)], "candidate string, parent string, score double")
    a = spark.createDataFrame([("c", "a", 0.0), ("c", "b", 1.0), ("c", "x", 1.0)], "candidate string, parent string, score double")
    got = decisions.fused_pairs(v, a, 0.5).orderBy("rank").collect()
    assert [(r.parent, r.score, r.margin) for r in got] == [("a", 0.5, 0.0), ("b", 0.5, None)]


def test_routing(spark):
    state = lambda s, p: F.struct(F.lit(s).alias("state"), F.lit(p).cast("string").alias("parent"))
    case = lambda v, a: spark.range(1).select(*decisions.route(v, a)).first()
    r = case(state("supported", "a"), state("supported", "b"))
    assert (r.visual_or_audio, r.visual_and_audio, r.disagreement, r.or_parent) == ("AMBIGUOUS", "AMBIGUOUS", True, None)
    r = case(state("supported", "a"), state("insufficient", None))
    assert (r.visual_or_audio, r.visual_and_audio, r.disagreement, r.or_parent, r.and_parent) == ("supported", "insufficient", True, "a", None)


def test_missing_is_not_zero(spark):
    df = rows(spark, {"score": None, "status": "not_evaluated"}).withColumn("truth", F.lit(True)).withColumn("decision", decisions.decision(F.lit(0.5), F.lit(1)))
    r = accounting.summary(df, ["method"]).first()
    assert (r.tp, r.fn, r.unavailable_positive, r.tpr, r.tpr_lower_bound) == (0, 0, 1, None, 0.0)


def test_nearest_against_brute_force(spark):
    ship(spark)
    r = random.Random(3)
    q = [(i, r.getrandbits(64) - 2**63) for i in range(20)] + [(99, None)]
    g = [(i, r.getrandbits(64) - 2**63) for i in range(200)] + [(500, None)]
    as_frame = lambda x: spark.createDataFrame(x, "id bigint, hash bigint")
    retrieval.BLOCK, held = 7, retrieval.BLOCK
    try:
        got = sorted((x.candidate, x.rank, x.parent, x.distance) for x in retrieval.nearest(as_frame(q), as_frame(g), 5).collect())
    finally:
        retrieval.BLOCK = held
    want = []
    for i, h in q[:-1]:
        best = sorted((((h ^ x) & (2**64 - 1)).bit_count(), p) for p, x in g[:-1])[:5]
        want += [(i, k + 1, p, d) for k, (d, p) in enumerate(best)]
    assert got == sorted(want)
    assert retrieval.nearest(as_frame([]), as_frame(g), 5).collect() == []


def test_banded_pairs_lose_none(spark):
    r = random.Random(4)
    g = [(i, r.getrandbits(63)) for i in range(60)]
    near = [(100 + i, h ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 3)))) for i, h in g]
    as_frame = lambda x: spark.createDataFrame(x, "id bigint, hash bigint")
    got = sorted((x.left_id, x.right_id, x.distance) for x in retrieval.banded_pairs(as_frame(g), as_frame(near)).collect())
    assert got == sorted((i, j, (a ^ b).bit_count()) for i, a in g for j, b in near if (a ^ b).bit_count() <= 3)
    with pytest.raises(ValueError):
        retrieval.banded_pairs(as_frame(g), as_frame(g), 4, 4)


def test_recall_reads_the_ranking_only(spark):
    top = spark.createDataFrame([("c", "wrong", 1)], "candidate string, parent string, rank int")
    truth = spark.createDataFrame([("c", "S1")], "candidate string, parent string")
    assert {(r.k, r.hits, r.n) for r in retrieval.recall_at(top, truth).collect()} == {(1, 0, 1), (5, 0, 1), (10, 0, 1)}


SEQ = "candidate array<bigint>, source array<bigint>, source_s double, candidate_s double"


def _warped(c, s, seconds, mine):
    """The block alignment again, with numpy."""
    pop = lambda x: np.bitwise_count(np.asarray(x, np.uint64)).astype(float)
    c, s = np.array(c, np.uint64), np.array(s, np.uint64)
    values = []
    for lo in range(0, len(c), 3):
        part = c[lo : lo + 3]
        best = -1.0
        for speed in alignment.SPEEDS:
            at = np.rint(np.arange(len(part)) * speed).astype(int)
            for off in range(max(0, len(s) - at[-1])):
                look = np.maximum(0, 1 - pop(part ^ s[off + at]) / 32).mean()
                if len(part) > 1:
                    move = np.maximum(0, 1 - pop(part[1:] ^ part[:-1] ^ s[off + at[1:]] ^ s[off + at[:-1]]) / 32).mean()
                    look = 0.7 * look + 0.3 * move
                best = max(best, look)
        values += [max(0, best)] * len(part)
    return float(np.mean(values)) * min(1, max(0, len(set(c.tolist())) - 1) / 2)


def test_warped_alignment(spark):
    r = random.Random(6)
    source = [r.getrandbits(63) for _ in range(14)]
    cases = [source[3:9], source[2:12:2], [r.getrandbits(63) for _ in range(5)], [source[0]] * 4, source[4:5]]
    df = spark.createDataFrame([(c, source, 14.0, float(len(c))) for c in cases] + [([], source, 14.0, 0.0)], SEQ)
    got = alignment.warped(df).collect()
    for c, x in zip(cases, got):
        assert x.score == pytest.approx(_warped(c, source, 14, len(c)), abs=1e-12)
    # Over three frames, speed .75 picks the same frames as 1 and is tried first, so the last block ends early.
    assert [(b.source.a, b.source.b, b.candidate.a, b.candidate.b) for b in got[0].blocks] == [(3, 8.25, 0, 6)]
    assert got[-1].status == "not_evaluated" and got[-1].score is None


def test_fragments_and_long_candidates(spark):
    r = random.Random(7)
    source = [r.getrandbits(63) for _ in range(40)]
    cases = [source[4:12], source[2:6] + source[30:34], [r.getrandbits(63) for _ in range(8)], source + source, []]
    got = alignment.align(spark.createDataFrame([(c, source, 1.0, 1.0) for c in cases], SEQ), most=20.0).collect()
    assert [x.status for x in got] == ["ok", "ok", "insufficient", "not_evaluated", "not_evaluated"]
    assert [x.n_fragments for x in got] == [1, 2, 0, 0, 0]
    assert [(i.a, i.b) for i in got[1].source_intervals] == [(1, 3), (15, 17)] and [(i.a, i.b) for i in got[0].source_intervals] == [(2, 6)]


def test_fingerprints(spark):
    s = [5, -1, 7, 9, 2**31]
    df = spark.createDataFrame([([-1, 7], s), ([7, 7], s), (s + [1], s), ([], s), (None, s)], "candidate array<bigint>, source array<bigint>")
    got = alignment.fingerprint_score(df).collect()
    assert (got[0].score, got[0].offset_frames) == (1.0, 1) and (got[1].score, got[1].reason) == (0.0, "uninformative_fingerprint")
    assert [g.reason for g in got[2:]] == ["candidate_fingerprint_longer_than_source", "no_fingerprint", "no_fingerprint"] and all(g.score is None for g in got[2:])


def test_partitions(spark):
    assets = spark.createDataFrame([("source", f"S{i}") for i in range(5)] + [("negative", "N1")], "role string, identity string")
    got = {r.identity: r.partition for r in partitioning.split_by_identity(assets).collect()}
    assert [got[f"S{i}"] for i in range(5)] == ["calibration"] * 2 + ["evaluation"] * 3 and got["N1"] == "calibration"
    p = spark.createDataFrame([("a", "calibration", "g", "k"), ("b", "evaluation", "g", None), ("b", "evaluation", "h", "k")], "id string, partition string, identity_group string, component_id string")
    assert {(r.rule, r.key) for r in partitioning.leaks(p).collect()} == {("duplicate_id", "b"), ("group_spans_partitions", "g"), ("component_spans_partitions", "k")}
    c = spark.createDataFrame([("c1", "a", None), ("c2", None, "b"), ("c3", None, "z")], "candidate_id string, expected_parent string, negative_id string")
    assert {r.candidate_id: r.partition for r in partitioning.inherit(c, p.dropDuplicates(["id"])).collect()} == {"c1": "calibration", "c2": "evaluation", "c3": "unknown"}


def test_design_is_complete(spark):
    d = design(spark)
    assert d.count() == 1512 and d.select("candidate_id").distinct().count() == 1512
    assert d.where("role = 'source'").count() == 16 * 7 * 12


@pytest.fixture
def log(spark):
    ship(spark)
    events = spark.createDataFrame([("x", i, f"body {i} receipt" if i == 3 else f"body {i}") for i in range(5)] + [("y", 1, "one")], "log string, at int, body string")
    return evidence.build_chain(events, "log", "at", "body")


def heads(log):
    return log.groupBy("log").agg(F.count("*").alias("sequence"), F.max_by("event_hash", "seq").alias("head"))


def test_chain_and_its_damages(spark, log):
    assert evidence.chain_violations(log).collect() == [] and all(r.valid for r in evidence.log_status(log, heads(log)).collect())
    changed = log.withColumn("body", F.when(F.col("seq") == 3, "forged").otherwise(F.col("body")))
    assert {(r.log, r.seq, r.reason) for r in evidence.chain_violations(changed).collect()} == {("x", 3, "event_chain_mismatch")}
    cut = log.where("NOT (log = 'x' AND seq = 2)")
    bad = {r.log: r for r in evidence.log_status(cut, heads(log)).collect()}
    assert (bad["x"].first_bad_seq, bad["x"].reason, bad["y"].valid) == (3, "event_chain_mismatch", True)
    short = {r.log: r.reason for r in evidence.log_status(log.where("seq < 5"), heads(log)).collect()}
    assert short == {"x": "checkpoint_count_mismatch", "y": None}
    other = heads(log).withColumn("head", F.lit("0"))
    assert {r.reason for r in evidence.log_status(log, other).collect()} == {"checkpoint_mismatch"}


def test_bundle_rules(spark, log):
    import base64

    one = log.where("log = 'x'")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    snapshot = spark.createDataFrame([("a", sha("doc a"), sha("f")), ("b", sha("doc b"), None)], "asset_id string, manifest_sha256 string, feature_sha256 string")
    manifests = spark.createDataFrame([("a", "doc a"), ("b", "doc b")], "asset_id string, document string")
    artifacts = spark.createDataFrame([(sha("f"), "f")], "digest string, content string")
    seed = bytes(range(32))
    b64 = lambda x: base64.b64encode(x).decode()
    signed = spark.createDataFrame([("receipt", "m", b64(public_key(seed)), b64(sign(seed, b"m")))], "name string, message string, public_key string, signature string")
    check = lambda **k: {(r.rule, r.key) for r in evidence.bundle_violations(**{"snapshot": snapshot, "manifests": manifests, "artifacts": artifacts, "chain": one, "checkpoint": heads(one), "receipt_digest": "receipt", "signed": signed, **k}).collect()}
    assert check() == set()
    assert check(manifests=manifests.where("asset_id = 'a'").withColumn("document", F.lit("forged"))) == {("manifest_digest", "a"), ("manifest_missing", "b")}
    assert check(artifacts=artifacts.withColumn("content", F.lit("g"))) == {("artifact_digest", sha("f"))}
    assert check(receipt_digest="absent", signed=signed.withColumn("message", F.lit("n"))) == {("receipt_not_in_log", "absent"), ("signature", "receipt")}


def test_lineage_validity(spark):
    children = spark.createDataFrame([("c", "d1"), ("c2", "d2")], "child string, child_sha256 string")
    derivatives = spark.createDataFrame([("d1", "p", "z1"), ("d2", "p", "z2"), ("d2", "unknown", None)], "child_sha256 string, parent_id string, authorization_id string")
    assets = spark.createDataFrame([("p",)], "id string")
    auth = spark.createDataFrame([("z1", "p", "d1", 10, 20), ("z2", "p", "d2", 10, 20)], "authorization_id string, parent_id string, child_sha256 string, valid_from int, valid_until int")
    revoked = spark.createDataFrame([("z2", 5), ("z2", 7)], "authorization_id string, revoked_at int")
    state = lambda at: {(r.child, r.state) for r in evidence.lineage(children, derivatives, assets, evidence.without_revoked(auth, revoked), F.lit(at)).collect()}
    assert state(10) == state(20) == {("c", "authorized"), ("c2", "unauthorized")} and state(21) == {("c", "unauthorized"), ("c2", "unauthorized")}


def test_interval_joins(spark):
    r = random.Random(8)
    make = lambda n: [(r.randint(0, 2), i, float(a), float(a + r.randint(0, 30))) for i, a in enumerate(r.randint(0, 200) for _ in range(n))]
    left, right = make(40), make(40)
    as_frame = lambda x: spark.createDataFrame(x, "k int, id int, a double, b double")
    got = sorted((x.k, x.left_id, x.right_id, x.shared) for x in evidence.interval_overlaps(as_frame(left), as_frame(right), ["k"], 7.0).collect())
    assert got == sorted((k, i, j, min(b, d) - max(a, c)) for k, i, a, b in left for m, j, c, d in right if k == m and max(a, c) < min(b, d))


@pytest.mark.parametrize("width", [1.0, 60.0, 1e9])
def test_intervals_of_seconds_and_years_meet(spark, width):
    r = random.Random(int(width))
    year = 31_536_000.0
    spans = lambda n: [(r.choice("ab"), i, (a := round(r.uniform(-year, 10 * year), r.choice([0, 2]))), a + r.choice([0.5, 1.0, 60.0, 86_400.0, year, 10 * year])) for i in range(n)]
    left, right = spans(150) + [("a", 900, 5.0, 5.0), ("a", 901, 0.0, 64.0)], spans(150) + [("a", 900, 64.0, 65.0), ("a", 901, 0.0, 1.0)]
    as_frame = lambda x: spark.createDataFrame(x, "k string, id int, a double, b double")
    got = sorted((x.k, x.left_id, x.right_id, round(x.shared, 6)) for x in evidence.interval_overlaps(as_frame(left), as_frame(right), ["k"], width).collect())
    assert got == sorted((k, i, j, round(min(b, d) - max(a, c), 6)) for k, i, a, b in left for m, j, c, d in right if k == m and max(a, c) < min(b, d))
    ten_years = as_frame([("a", 1, 17.0, 17.0 + 10 * year)])
    assert evidence._cover(ten_years, 30, 1.0).count() <= 60


def test_run_comparison_classes(spark):
    a = spark.createDataFrame([(1, "ok", "d", 0.5), (2, "ok", "e", None)], "id int, status string, digest string, score double")
    kind = lambda b: accounting.compare_runs(a, b, "id").first().reproducibility
    assert kind(a) == "BIT_DETERMINISTIC" and kind(a.where("id = 1")) == "UNSTABLE"
    assert kind(a.withColumn("score", F.col("score") + 1e-9).withColumn("digest", F.lit("x"))) == "TOLERANCE_REPRODUCIBLE"
    worst = spark.range(1).select(accounting.worst_class(F.array(F.lit("BIT_DETERMINISTIC"), F.lit("UNSTABLE"))).alias("w")).first().w
    assert worst == "UNSTABLE"
    verdict = lambda *x: spark.range(1).select(accounting.overall_verdict(*[F.lit(v).cast("double") if i > 2 else F.lit(v) for i, v in enumerate(x)]).alias("v")).first().v
    assert verdict("NO-GO", "NO-GO", "GO", 0.9, 0.8, 0.0) == "CORE NO-GO" and verdict("GO", "GO", "NO-GO", 0.9, 0.8, 0.0) == "CORE NO-GO"
    assert verdict("GO", "NO-GO", "GO", 0.9, 0.8, 0.0) == "CORE GO" and verdict("GO", "GO", "CAUTION", 0.9, 0.8, 0.0) == "CAUTION"
    assert verdict("GO", "GO", "GO", 0.9, 0.8, 0.02) == "STRONG GO" and verdict("GO", "GO", "GO", 0.8, 0.8, 0.0) == "CORE GO" and verdict("GO", "GO", "GO", 0.9, 0.8, 0.03) == "CORE GO"
    assert verdict("GO", "GO", "GO", None, None, None) == "CORE GO"


def test_alignment_verdict_needs_every_measure(spark):
    kind = "g int, all_mean_iou double, all_coverage double, issued_mean_start_error double, issued_mean_end_error double, issued_n_several bigint, issued_n_false_continuous bigint"
    cases = [(1, 0.8, 0.9, 0.5, 0.5, 10, 0), (2, 0.8, 0.9, 0.5, 0.5, 0, 0), (3, 0.8, 0.9, None, 0.5, 10, 0), (4, 0.8, 0.9, 0.5, 0.5, 10, 3), (5, 0.6, 0.9, 0.5, 0.5, 10, 0)]
    got = [r.verdict for r in accounting.alignment_verdict(spark.createDataFrame(cases, kind)).orderBy("g").collect()]
    assert got == ["GO", "CAUTION", "CAUTION", "NO-GO", "CAUTION"]


def test_running_sums_over_ranges(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), float(r.randint(0, 40)), 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, x double, n bigint")
    for down in (False, True):
        got = calibration.running_sums(df, ["k"], "x", ["n"], descending=down).collect()
        assert len(got) == 300 and all(g.n == sum(k == g.k and (x >= g.x if down else x <= g.x) for k, x, _ in rows) for g in got)
    assert calibration.running_sums(df.where("false"), ["k"], "x", ["n"]).collect() == []


def test_near_links_count_without_pairs_of_copies(spark):
    r = random.Random(6)
    hashes = [r.getrandbits(64) for _ in range(40)]
    hashes += [h ^ (1 << r.randint(0, 63)) ^ (1 << r.randint(0, 63)) for h in hashes for _ in range(3)] + [hashes[0]] * 50
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)] + [(900, None)]
    got = {x.id: x for x in retrieval.near_links(spark.createDataFrame(rows, "id bigint, hash bigint"), 3).collect()}
    assert len(got) == len(rows) and (got[900].class_id, got[900].n_links) == (900, 0)
    for i, h in enumerate(hashes):
        near = [(h ^ g).bit_count() for j, g in enumerate(hashes) if j != i and (h ^ g).bit_count() <= 3]
        beyond = [x for x in near if x]
        assert (got[i].class_id, got[i].n_links, got[i].nearest) == (hashes.index(h), len(near), min(beyond) if beyond else None)


def test_resource_check():
    assert accounting.resource_check(1512, 5.674, 500_000, 10**12)["decision"] == "proceed"
    with pytest.raises(ValueError, match="exceeds"):
        accounting.resource_check(1512, 50.0, 500_000, 10**12)
