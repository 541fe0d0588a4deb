import hashlib
import json

import pytest
from pyspark.sql import functions as F

from derivata.functions import canonical, signatures
from derivata.functions.canonical import digest_of
from derivata.operators import evidence, partitioning
from derivata.shipping import ship
from derivata.sources import readers, sinks
from derivata.streaming import ledger, scoring


def test_manifests_and_truth(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"asset_id": "S1", "sha256": "x", "extra": {"k": "v"}, "fps": 12.0}]))
    r = readers.read_manifest(spark, f"file://{tmp_path}/m.json").first()
    assert (r.asset_id, r.fps, r.extra) == ("S1", 12.0, {"k": "v"})
    (tmp_path / "t.json").write_text(json.dumps([{"candidate_id": "c", "source_intervals_ms": [[0, 5], [7, 9]], "candidate_intervals_ms": []}]))
    r = readers.read_ground_truth(spark, f"file://{tmp_path}/t.json").first()
    assert [(x.start_ms, x.end_ms) for x in r.source_intervals_ms] == [(0, 5), (7, 9)] and r.candidate_intervals_ms == []


def test_journals(spark, tmp_path):
    path = f"file://{tmp_path}/j.jsonl"
    assert readers.read_journal(spark, path, "id int").collect() == []
    (tmp_path / "j.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n{"id": ')
    assert sorted(r.id for r in readers.read_journal(spark, path, "id int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": \n{"id": 2}\n')
    with pytest.raises(Exception, match="malformed line"):
        readers.read_journal(spark, f"file://{tmp_path}/bad.jsonl", "id int").collect()
    (tmp_path / "none.jsonl").write_text("")
    assert readers.read_journal(spark, f"file://{tmp_path}/none.jsonl", "id int").collect() == []


def test_partitions_and_profiles_are_guarded(spark, tmp_path):
    path = f"file://{tmp_path}/p.json"
    good = {"assignments": [{"id": "a", "identity_group": "g", "component_id": None, "partition": "calibration"}, {"id": "b", "identity_group": "h", "partition": "evaluation"}]}
    (tmp_path / "p.json").write_text(json.dumps(sinks.with_own_digest(good)))
    assert sorted(r.id for r in readers.read_partition(spark, path).collect()) == ["a", "b"]
    leaky = {"assignments": [dict(good["assignments"][0]), dict(good["assignments"][1], identity_group="g")]}
    (tmp_path / "q.json").write_text(json.dumps(sinks.with_own_digest(leaky)))
    with pytest.raises(ValueError, match="leaks"):
        readers.read_partition(spark, f"file://{tmp_path}/q.json")
    (tmp_path / "r.json").write_text(json.dumps({**good, "sha256": "0"}))
    with pytest.raises(ValueError, match="digest"):
        readers.read_partition(spark, f"file://{tmp_path}/r.json")
    (tmp_path / "t.json").write_text(json.dumps(sinks.with_own_digest({"threshold": 0.5}, "profile_sha256")))
    assert readers.read_profile(spark, f"file://{tmp_path}/t.json")["threshold"] == 0.5


def test_registry_and_digest_guards(spark):
    assets = spark.createDataFrame([("S1", "p1", "d1", "source", "active"), ("S2", "p2", "d2", "source", "other"), ("N1", "p3", "d3", "negative", "active")], "asset_id string, path string, sha256 string, role string, partition string")
    files = spark.createDataFrame([("p1", "d1"), ("p2", "x")], "path string, sha256 string")
    assert [r.asset_id for r in readers.registry_of(assets, files, "active").collect()] == ["S1"]
    with pytest.raises(Exception, match="source changed: p2"):
        readers.registry_of(assets, files, "other").collect()
    a = spark.createDataFrame([("m", "1"), ("n", "2"), ("o", "3")], "name string, sha256 string")
    b = spark.createDataFrame([("m", "1"), ("n", "9"), ("q", "3")], "name string, sha256 string")
    assert {r.name for r in readers.changed_digests(a, b).collect()} == {"n", "o", "q"}


def test_media_tools_are_adapters(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"not media")
    probed = readers.media_table(spark, f"file://{tmp_path}", command=("no-such-tool",)).collect()
    assert [(r.probe, r.reason) for r in probed] == [(None, "not_installed: no-such-tool")]
    failed = readers.media_table(spark, f"file://{tmp_path}", command=("false",)).first()
    assert failed.probe is None and failed.reason.startswith("failed")
    document = json.dumps({"format": {"duration": "4.5"}, "streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 64, "height": 48, "r_frame_rate": "25/1"}]})
    df = spark.createDataFrame([("p", document, None), ("q", None, "failed")], "path string, probe string, reason string")
    r, q = readers.media_properties(df).orderBy("path").collect()
    assert (r.duration_s, r.width, r.height, r.fps, r.has_audio, r.codec_video, r.codec_audio) == (4.5, 64, 48, 25.0, True, "h264", "aac") and q.width is None and q.reason == "failed"
    log = spark.createDataFrame([("n: 0 pts_time:0 x\nn: 1 pts_time:0.5 y",), ("",)], "t string")
    assert [r.v for r in log.select(readers.frame_times_of(F.col("t")).alias("v")).collect()] == [[0.0, 0.5], []]
    variants = spark.createDataFrame([("i", 480, "u"), ("i", 1080, "v"), ("i", 700, "w"), ("i", 740, "x"), ("j", None, "y")], "item string, height int, url string")
    assert [(r.item, r.height, r.url) for r in readers.nearest_height(variants, "item").collect()] == [("i", 700, "w")]
    assert "numpy" in readers.environment(spark).first().packages


def test_immutable_documents(spark, tmp_path):
    path = f"file://{tmp_path}/d.json"
    digest = sinks.dump(spark, path, {"b": 1, "a": "é"})
    assert sinks.dump(spark, path, {"a": "é", "b": 1}) == digest and json.loads(readers.read_guarded(spark, path)) == {"a": "é", "b": 1}
    with pytest.raises(ValueError):
        sinks.dump(spark, path, {"b": 2})
    sinks.dump(spark, path, {"b": 2}, immutable=False)
    assert json.loads(readers.read_guarded(spark, path)) == {"b": 2}
    (tmp_path / ".d.json.sha256.crc").unlink()
    (tmp_path / "d.json.sha256").write_text("0" * 64)
    with pytest.raises(ValueError):
        readers.read_guarded(spark, path)
    own = sinks.with_own_digest({"a": 1})
    assert own["sha256"] == digest_of({"a": 1}) and sinks.with_own_digest(own) == own


def test_artifacts_are_put_once(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    rows = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "content string")
    assert sinks.put_artifacts(rows, path) == 2 and sinks.put_artifacts(rows, path) == 0
    stored = spark.read.parquet(path)
    assert evidence.damaged(stored).collect() == [] and evidence.damaged(stored.withColumn("content", F.lit("z"))).count() == 2


def test_scan_directory(spark, tmp_path):
    for name in ("b.MP4", "a.mkv", "c.txt", "d.avi"):
        (tmp_path / name).write_text(name)
    got = readers.scan_directory(spark, f"file://{tmp_path}", "source").orderBy("asset_id").collect()
    assert [(r.asset_id, r.filename) for r in got] == [("S001", "a.mkv"), ("S002", "b.MP4"), ("S003", "d.avi")]
    assert got[0].sha256 == hashlib.sha256(b"a.mkv").hexdigest()
    assert sinks.digest_index(spark, f"file://{tmp_path}").count() == 4


def test_media_rules(spark):
    rows = spark.createDataFrame([("a", 10.0, 4, 4), ("b", 0.0, 4, 4), ("c", 9e9, 4, 4), ("d", 5.0, None, 4), ("e", float("nan"), 4, 4)], "id string, duration_s double, width int, height int")
    good, bad = readers.valid_media(rows)
    assert [r.id for r in good.collect()] == ["a"] and {r.id: r.reason for r in bad.collect()} == {"b": "no_duration", "c": "too_long", "d": "no_video_stream", "e": "no_duration"}
    rates = spark.createDataFrame([("30000/1001",), ("25/1",), ("1/0",), ("x",), ("12",)], "f string")
    assert [round(r.v, 2) for r in rates.select(readers.frame_rate(F.col("f")).alias("v")).collect()] == [29.97, 25.0, 0.0, 0.0, 12.0]


def test_scoring_stream_resumes_and_refuses_repeats(spark, tmp_path):
    ship(spark)
    source, out, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/cp"
    source.mkdir()
    far = (1 << 40) - 1
    registry = spark.createDataFrame([(1, 0b1111), (2, -1)], "id bigint, hash bigint")

    def run():
        stream = scoring.candidate_stream(spark, f"file://{source}", "candidate_id bigint, hash bigint")
        scoring.score_stream(stream, registry, f"file://{out}", f"file://{checkpoint}").awaitTermination(120)
        return {r.candidate_id: (r.parent, r.distance, r.status) for r in spark.read.parquet(f"file://{out}").collect()}

    (source / "1.json").write_text(f'{{"candidate_id": 1, "hash": 7}}\n{{"candidate_id": 2, "hash": {far}}}\n{{"candidate_id": 3}}\n')
    first = {1: (1, 1, "evaluated"), 2: (2, 24, "evaluated"), 3: (None, None, "not_evaluated")}
    assert run() == first
    (source / "2.json").write_text('{"candidate_id": 4, "hash": -2}\n')
    assert run() == {**first, 4: (2, 1, "evaluated")} and run() == {**first, 4: (2, 1, "evaluated")}
    (source / "3.json").write_text('{"candidate_id": 1, "hash": 0}\n')
    with pytest.raises(Exception, match="came twice"):
        run()


def test_log_stream_is_one_chain(spark, tmp_path):
    ship(spark)
    source = tmp_path / "in"
    source.mkdir()
    schema, seed = "kind string, subject string, document string", bytes(range(32))
    for k in range(2):
        (source / f"{k}.json").write_text("".join(json.dumps({"kind": "k", "subject": f"s{k}{i}", "document": str(i)}) + "\n" for i in range(3)))
        stream = spark.readStream.schema(schema).json(f"file://{source}")
        ledger.log_stream(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/cp", seed).awaitTermination(120)
    chain = ledger.read_log(spark, f"file://{tmp_path}/log")
    assert sorted(r.seq for r in chain.collect()) == [1, 2, 3, 4, 5, 6] and evidence.chain_violations(chain).collect() == []
    marks = chain.select("log", "seq", F.col("checkpoint").alias("envelope"))
    status = lambda c, m: tuple(evidence.signed_log_status(c, m, signatures.pem(signatures.public_key(seed))).first())[1:]
    assert status(chain, marks) == (6, True, None, None)
    assert status(chain.withColumn("body", F.when(F.col("seq") == 4, "x").otherwise(F.col("body"))), marks) == (6, False, "event_chain_mismatch", 4)
    assert status(chain, marks.where("seq < 6")) == (6, False, "checkpoint_count_mismatch", None)
    other = evidence.checkpoints(chain.where("seq = 5"), bytes(32), "now").unionByName(marks.where("seq <> 5"))
    assert status(chain, other) == (6, False, "checkpoint_mismatch", 5)


def test_guards(spark):
    scoring.resume_guard({"a": "1"}, {"a": "1"})
    with pytest.raises(ValueError, match="b"):
        scoring.resume_guard({"a": "1", "b": "2"}, {"a": "1", "b": "3"})
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, label string")
    fixed = spark.createDataFrame([(1, "x"), (2, "n")], "id int, label string")
    assert sorted(r.id for r in scoring.label_drift(rows, fixed, "id", ["label"]).collect()) == [2, 3]


def test_media_are_staged_and_kept_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a", b"xx"), ("b", b"xx"), ("c", b""), ("d", b"12345678"), ("e", b"y")):
        (tmp_path / "in" / name).write_bytes(content)
    good, refused = sinks.stage(spark, f"file://{tmp_path}/in", 5)
    assert good.count() == 3 and {r.path[-1]: r.reason for r in refused.collect()} == {"d": "too_large"}
    path = f"file://{tmp_path}/store"
    assert sinks.persist_media(good, path) == 2 and sinks.persist_media(good, path) == 0
    with pytest.raises(Exception, match="not the bytes"):
        sinks.persist_media(good.withColumn("sha256", F.lit("0" * 64)), path)


def test_exports_revisions_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.5, "x|y"), (1, None, "z")], "id int, score double, note string")
    files = sinks.export(rows.coalesce(1), f"file://{tmp_path}/out", "id").collect()
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert [json.loads(x)["id"] for x in text.splitlines()] == [1, 2] and files[0].sha256 == hashlib.sha256(text.encode()).hexdigest()
    path = f"file://{tmp_path}/t"
    assert sinks.revise(rows, path, "first") == 1 and sinks.revise(rows.where("id = 1"), path, "fewer") == 2
    assert sinks.current(spark, path).count() == 1 and sinks.current(spark, path, 1).count() == 2
    assert sinks.revision_is_whole(spark, path) and sinks.revision_is_whole(spark, path, 1)
    assert sinks.markdown_table(rows.orderBy("id"), "id", "score", "note") == "| id | score | note |\n| --- | --- | --- |\n| 1 | not evaluated | z |\n| 2 | 0.500 | x\\|y |\n"
    with pytest.raises(ValueError, match="no table"):
        sinks.markdown_table(rows, "id", most=1)


def test_maps_and_nested_fields(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}, '{"x": {"y": null, "z": 5}}'), (None, None, None)], "m map<string,string>, n map<string,string>, d string")
    got = df.select(canonical.merged_maps(F.col("m"), F.col("n")).alias("m"), canonical.nested(F.col("d"), "x.z", "none").alias("z"), canonical.nested(F.col("d"), "x.y", "none").alias("y"), canonical.random_id("a").alias("i")).collect()
    assert (got[0].m, got[0].z, got[0].y) == ({"a": "1", "b": "3"}, "5", "none") and (got[1].m, got[1].z) == ({}, "none")
    assert got[0].i != got[1].i and len(got[0].i) == 34


def test_representative_subset(spark):
    rows = [("calibration", r, i, 5, t) for r, i in (("source", "S2"), ("source", "S1"), ("negative", "N3"), ("negative", "N1")) for t in ("trim", "mirror")] + [("calibration", "source", "S1", 10, "trim")]
    df = spark.createDataFrame(rows, "partition string, role string, identity string, length_s int, transform string")
    got = {(r.identity, r.transform) for r in partitioning.representative_subset(df).collect()}
    assert got == {("S1", "trim"), ("N1", "trim"), ("N1", "mirror")}
