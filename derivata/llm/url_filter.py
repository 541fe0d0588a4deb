"""URL filters by dated lists: a temporal join of captures and list entries.

A list is a log of dated entries (kind, key, action, day): kind ``domain`` (a host with all its subdomains) or
``prefix`` (host and path, up to a segment's end), action ``add`` or ``remove``. The entries of a key, by day, become
validity intervals: from an ``add`` to the next entry. A capture is evaluated as of its fetch time: of each key that
it falls under, the last entry up to then decides.

Keys are equi-joined, never compared pairwise: a capture asks for its host, the host's parent domains, and its path's
prefixes. Captures of one address and time are evaluated once, so a host with a third of all captures repeats no work;
the join by host is one that adaptive execution can split.

Hosts and paths match whatever their case, as people write lists by hand. Null or malformed URLs fall under no key; captures without a fetch time precede all entries; both pass. Entries of one
day: a ``remove`` comes last. Repeated entries change nothing. A repeated ``add`` keeps the first day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, valid_from, valid_to): the times during which a key is listed; valid_to is null while it lasts."""
    clean = entries.where("key IS NOT NULL AND kind IN ('domain', 'prefix') AND action IN ('add', 'remove') AND day IS NOT NULL")
    last = clean.select("kind", F.lower("key").alias("key"), F.col("day").cast("timestamp").alias("day"), (F.col("action") == "add").alias("on")).groupBy("kind", "key", "day").agg(F.min("on").alias("on"))
    by_key = W.partitionBy("kind", "key").orderBy("day")
    turns = last.withColumn("before", F.lag("on").over(by_key)).where("on <> coalesce(before, false)")
    return turns.withColumn("valid_to", F.lead("day").over(by_key)).where("on").select("kind", "key", F.col("day").alias("valid_from"), "valid_to")


def address_keys(url):
    """array<struct<kind, key>> of the list keys that a URL falls under."""
    part = lambda n: F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d*)?(/[^?#]*)?", n)
    host = F.lower(F.rtrim(part(1), F.lit(".")))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i + 1, n - i), ".").alias("key")))
    steps = F.filter(F.split(F.lower(part(2)), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.when(i > 0, F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("key")))
    return F.when(host != "", F.concat(domains, prefixes))


def url_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked, list_kind, list_key and listed_since: of the keys listed at fetch time, the one listed
    longest (ties: by kind and key). Columns with these names are replaced; others pass unchanged."""
    added = ("blocked", "list_kind", "list_key", "listed_since")
    names = {c: f"c{i}" for i, c in enumerate(captures.columns) if c not in added}
    inner = captures.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    url, at = names[url_col], names[time_col]
    asked = inner.select(F.col(url).alias("u"), F.col(at).cast("timestamp").alias("t")).where("u IS NOT NULL AND t IS NOT NULL").distinct()
    keys = asked.select("u", "t", F.explode(address_keys(F.col("u"))).alias("k")).select("u", "t", "k.kind", "k.key")
    active = keys.join(intervals(entries), ["kind", "key"]).where("valid_from <= t AND (valid_to IS NULL OR t < valid_to)")
    verdict = active.groupBy("u", "t").agg(F.min(F.struct("valid_from", "kind", "key")).alias("v"))
    out = inner.join(verdict, (inner[url] == verdict.u) & (inner[at].cast("timestamp") == verdict.t), "left")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("v").isNotNull().alias("blocked"), F.col("v.kind").alias("list_kind"), F.col("v.key").alias("list_key"), F.col("v.valid_from").alias("listed_since"))
