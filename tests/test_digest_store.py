import hashlib
import re

import pytest
from pyspark.sql import functions as F

from derivata.sources import sinks

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_store(plan, name):
    """The operators between the store's scan and the first join above it."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if f"{name}" in line and "FileScan" in line)
    out, depth = [], len(re.match(r"[\s:+\-|]*", lines[at])[0])
    for line in reversed(lines[:at]):
        own = len(re.match(r"[\s:+\-|]*", line)[0])
        if own < depth:
            depth = own
            out.append(line)
            if "Join" in line:
                break
    return out


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    store = sinks.DigestStore(spark, f"file://{tmp_path}/s", buckets=4)
    texts = spark.range(300).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"))
    assert store.put(texts) == 300 and store.put(texts.limit(20)) == 0 and store.put(texts.limit(5).union(spark.sql("SELECT 'new' AS content UNION ALL SELECT 'new' UNION ALL SELECT NULL"))) == 1
    wanted = spark.createDataFrame([(sha("text 7"),), (sha("new"),), (sha("none"),), (sha("new"),)], "digest string")
    got = store.get(wanted)
    assert sorted(r.content for r in got.collect()) == ["new", "text 7"]
    for df in (got, store._dealt(texts.select(F.sha2("content", 256).alias("digest"), "content")).join(store.rows().select("digest").hint("merge"), "digest", "left_anti")):
        found = above_store(plan_of(df), store.name)
        assert "Join" in found[-1] and not any("Exchange" in x for x in found), plan_of(df)


def test_compaction_and_reopening(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = sinks.DigestStore(spark, path, buckets=3)
    for i in range(4):
        assert store.put(spark.createDataFrame([(f"{i}-{k}",) for k in range(30)], "content string")) == 30
    assert store.compact() >= 12 and len(store.rows().inputFiles()) <= 3
    again = sinks.DigestStore(spark, path, buckets=99)
    assert again.buckets == 3 and again.name == store.name and again.rows().count() == 120
    assert again.put(spark.createDataFrame([("0-0",), ("x",)], "content string")) == 1


def test_spoilt_content_is_refused(spark, tmp_path):
    store = sinks.DigestStore(spark, f"file://{tmp_path}/s", buckets=2)
    spark.createDataFrame([(sha("a"), "b")], "digest string, content string").write.insertInto(store.name)
    with pytest.raises(Exception, match="not the content"):
        store.get(spark.createDataFrame([(sha("a"),)], "digest string")).collect()
