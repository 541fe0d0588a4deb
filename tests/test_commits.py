import json
import threading

import pytest

from derivata.functions import shared
from derivata.operators import evidence
from derivata.shipping import ship
from derivata.sources import commits, readers, sinks
from derivata.streaming import ledger, scoring


class Killed(BaseException):
    pass


def rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id int")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_file_is_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    assert shared.get_text(spark, path) is None and shared.create_absent(spark, path, "ü1")
    assert not shared.create_absent(spark, path, "2") and shared.get_text(spark, path) == "ü1"
    assert [n for n, _ in shared.names_in(spark, f"file://{tmp_path}/a") if not n.endswith(".crc")] == ["b.json"]


def test_versions_heads_and_old_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "EVERY", 3)
    path = f"file://{tmp_path}/s"
    assert commits.state(spark, path) == commits.State()
    for i in range(1, 9):
        commits.commit(spark, path, lambda now, i=i: commits.Change(append={"a": rows(spark, i)}, head={"n": now.head.get("n", 0) + i}))
    assert ids(commits.read(spark, path, "a")) == list(range(1, 9)) and commits.state(spark, path).head == {"n": 36}
    assert ids(commits.read(spark, path, "a", 4)) == [1, 2, 3, 4] and commits.state(spark, path, 5).head == {"n": 15}
    shared.delete(spark, f"{path}/_commits/hint")
    assert commits.last_version(spark, path) == 8
    before = commits.state(spark, path)
    assert commits.commit(spark, path, lambda now: None) == before
    after = commits.compact(spark, path, "a", 2)
    assert ids(commits.read(spark, path, "a")) == list(range(1, 9)) and len(after.tables["a"]) == 1 and after.head == {"n": 36}
    with pytest.raises(ValueError, match="no version 99"):
        commits.state(spark, path, 99)
    with pytest.raises(ValueError, match="no table b"):
        commits.read(spark, path, "b")


def test_a_forged_commit_is_named(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for i in range(3):
        commits.commit(spark, path, lambda now, i=i: commits.Change(append={"a": rows(spark, i)}))
    pointer = commits._pointer(path, 2)
    document = json.loads(shared.get_text(spark, pointer))
    shared.put_text(spark, pointer, json.dumps({**document, "reason": "forged"}))
    with pytest.raises(ValueError, match="version 3 does not follow"):
        commits.state(spark, path)


@pytest.mark.parametrize("step", ["second table", "pointer", "hint"])
def test_a_writer_killed_between_the_steps_leaves_nothing_half_written(spark, tmp_path, monkeypatch, step):
    ship(spark)
    path = f"file://{tmp_path}/s"
    event = lambda i: spark.createDataFrame([("k", f"s{i}", "d")], "kind string, subject string, document string")
    ledger.record(spark, path, event(0), {"assets": rows(spark, 0)})
    with monkeypatch.context() as m:
        if step == "second table":
            real, calls = commits.staged, []

            def staged(df, where, table):
                calls.append(table)
                if len(calls) == 2:
                    raise Killed
                return real(df, where, table)

            m.setattr(commits, "staged", staged)
        elif step == "pointer":
            m.setattr(commits, "create_absent", lambda *a: (_ for _ in ()).throw(Killed))
        else:
            m.setattr(commits, "put_text", lambda *a: (_ for _ in ()).throw(Killed))
        with pytest.raises(Killed):
            ledger.record(spark, path, event(1), {"assets": rows(spark, 1)}, step=("s", 1))
    done = step == "hint"
    for _ in range(2):  # rows and events are there together or not at all, also after doing it again
        chain = ledger.read_log(spark, path)
        assert ids(commits.read(spark, path, "assets")) == list(range(1 + done)) and chain.count() == 1 + done
        assert commits.state(spark, path).head["seq"] == 1 + done and evidence.chain_violations(chain).count() == 0
        ledger.record(spark, path, event(1), {"assets": rows(spark, 1)}, step=("s", 1))
        done = True
    commits.vacuum(spark, path, 0)
    assert ids(commits.read(spark, path, "assets")) == [0, 1] and ledger.read_log(spark, path).count() == 2
    assert commits.vacuum(spark, path, 0) == 0


def test_the_head_costs_no_scan_of_the_log(spark, tmp_path):
    ship(spark)
    path = f"file://{tmp_path}/s"
    event = lambda i: spark.createDataFrame([("k", f"s{i}", "d")], "kind string, subject string, document string")
    ledger.record(spark, path, event(0))
    for folder in commits.state(spark, path).tables["events"]:
        shared.delete(spark, f"{path}/{folder}")  # whoever reads the log now, fails
    assert ledger.record(spark, path, event(1)).head["seq"] == 2


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = f"file://{tmp_path}/s", []

    def write(k):
        try:
            for i in range(3):
                sinks.revise(rows(spark, 10 * k + i), path, f"{k}.{i}")
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and commits.last_version(spark, path) == 6
    assert sorted(ids(sinks.current(spark, path, v))[0] for v in range(1, 7)) == [0, 1, 2, 10, 11, 12]


def test_scoring_reads_nothing_again_and_refuses_what_it_must(spark, tmp_path):
    ship(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    registry = spark.createDataFrame([(1, 15), (2, -1)], "id bigint, hash bigint")
    design = spark.createDataFrame([(i, f"l{i % 3}") for i in range(200)], "candidate_id bigint, label string")

    def run(checkpoint="cp", **more):
        stream = scoring.candidate_stream(spark, f"file://{source}", "candidate_id bigint, hash bigint, label string", 2)
        query = scoring.score_stream(stream, registry, f"file://{out}", f"file://{tmp_path}/{checkpoint}", design=design, labels=("label",), **more)
        query.awaitTermination(300)
        return query.recentProgress

    line = lambda i, label=None: json.dumps({"candidate_id": i, "hash": i, "label": label or f"l{i % 3}"}) + "\n"
    for f in range(20):
        (source / f"{f:02}.json").write_text("".join(line(f * 5 + i) for i in range(5)))
    progress = run(signature={"code": "1"})
    assert [p.numInputRows for p in progress if p.numInputRows] == [10] * 10
    assert sorted(r.candidate_id for r in spark.read.parquet(f"file://{out}").collect()) == list(range(100))
    for file in out.rglob("*.parquet"):
        file.write_bytes(b"spoilt")  # whoever reads what was written, fails
    (source / "x1.json").write_text("\n" + line(150))
    assert [p.numInputRows for p in run() if p.numInputRows] == [2]  # lines, a blank one too
    for name, text, reason in (("x2", line(3), "came twice"), ("x2", line(151, "other"), "diverge"), ("x2", '{"candidate_id": 1', "malformed line"), ("x2", "null\n", "malformed|without a key")):
        (source / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match=reason):
            run()
    with pytest.raises(ValueError, match="code"):
        run(signature={"code": "2"})


@pytest.mark.parametrize("split", [50, 200, 777, 5000])
def test_journals_lose_no_line_at_any_split(spark, tmp_path, split):
    a = "".join(json.dumps({"id": i, "t": "x" * (i * 37 % 90)}) + "\n" for i in range(40)) + json.dumps({"id": 40, "t": "y" * 2000})
    b = "\n".join(json.dumps({"id": 100 + i, "t": ""}) for i in range(5)) + '\n\n{"id": 999, "t": "unfin'
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        (tmp_path / "a.jsonl").write_text(a)
        (tmp_path / "b.jsonl").write_text(b)
        got = readers.read_journal(spark, f"file://{tmp_path}/*.jsonl", "id bigint, t string").collect()
        assert sorted(r.id for r in got) == [*range(41), *range(100, 105)] and max(len(r.t) for r in got) == 2000
        # The same text inside of a file is an error, although the file's last line is allowed to be like it.
        (tmp_path / "c.jsonl").write_text('{"id": 1, "t": "unfin\n{"id": 2, "t": ""}\n{"id": 1, "t": "unfin')
        with pytest.raises(Exception, match="malformed line"):
            readers.read_journal(spark, f"file://{tmp_path}/*.jsonl", "id bigint, t string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_counted_rows_keep_their_columns(spark):
    assert scoring.counted_stream(spark.createDataFrame([(1, 2)], "k bigint, hash bigint"), "k").select("row.*").columns == ["k", "hash"]
