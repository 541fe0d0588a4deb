import collections
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from derivata.sources import eventlog

JOB = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "3").getOrCreate()
for name, n in (("small", 1000), ("large", 50000)):
    spark.sparkContext.setJobGroup(name, name)
    spark.range(n).groupBy(F.col("id") % 7).count().collect()
spark.stop()
"""


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    subprocess.run([sys.executable, "-c", JOB, f"file://{folder}"], check=True, capture_output=True, timeout=180, env=os.environ)
    return next(x for x in Path(folder).iterdir() if not x.name.startswith("."))


def test_sums_are_those_of_the_log(spark, log):
    want = collections.defaultdict(lambda: [0, 0.0, 0, 0])
    for line in log.read_text().splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerTaskEnd":
            m, s = e["Task Metrics"], want[e["Stage ID"]]
            s[0] += 1
            s[1] += m["Executor CPU Time"] / 1e9
            s[2] += m["Shuffle Write Metrics"]["Shuffle Bytes Written"]
            s[3] = max(s[3], m["Peak Execution Memory"])
    events = eventlog.read_events(spark, f"file://{log}")
    got = {r.stage: [r.tasks, r.cpu_s, r.shuffle_written_bytes, r.peak_bytes] for r in eventlog.stage_usage(events).collect()}
    assert got.keys() == want.keys() and len(got) >= 4 and all(got[k] == pytest.approx(want[k]) for k in want)
    groups = {r.job_group: r for r in eventlog.group_usage(events).collect()}
    assert groups.keys() == {"small", "large"} and sum(r.tasks for r in groups.values()) == sum(s[0] for s in want.values())
    assert sum(r.cpu_s for r in groups.values()) == pytest.approx(sum(s[1] for s in want.values()))


def test_a_log_that_is_still_written(spark, log, tmp_path):
    (tmp_path / "open").write_text(log.read_text() + '{"Event": "SparkListenerTa')
    assert eventlog.stage_usage(eventlog.read_events(spark, f"file://{tmp_path}/open")).count() == eventlog.stage_usage(eventlog.read_events(spark, f"file://{log}")).count()
