"""A Merkle tree over a registry, so that checking one record takes its own path and not all records.

An asset's place is the SHA-256 of its id; a node is a prefix of places, one hexadecimal digit a level. A bucket is a
prefix of ``depth`` digits and has the assets below it, some 16 with the depth that :func:`depth_for` gives. Buckets and
nodes are the digests of their parts' lines in order, so each level is one grouped aggregation, a group has 16 parts (or a
bucket's assets), and a change touches the nodes above it only. No order of all assets is needed.

A proof is an array of texts from the bucket up: the lines of the node, with ``*`` for the digest that comes from below. So
built-in functions fold it. leaves: (id, digest). nodes: (prefix, digest, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordinals import checkpointed


def depth_for(n_assets: int) -> int:
    """Levels below the root for buckets of 16 assets at most, on the average."""
    depth = 0
    while 16 ** (depth + 1) < n_assets:
        depth += 1
    return depth


def place(asset: Column) -> Column:
    return F.sha2(asset.cast("string"), 256)


def _lines(parts: str) -> Column:
    """The text of a node from an array of structs (name, digest)."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: F.concat_ws(":", x["name"], x["digest"])), "\n")


def _buckets(leaves: DataFrame, depth: int) -> DataFrame:
    named = leaves.select(place(F.col("id")).alias("name"), "digest").where("name IS NOT NULL AND digest IS NOT NULL").distinct()
    return named.groupBy(F.substring("name", 1, depth).alias("prefix")).agg(F.collect_list(F.struct("name", "digest")).alias("parts"), F.count("*").alias("n"))


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """(prefix, parts, n) of the nodes of a level from those beneath."""
    return nodes.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(F.collect_list(F.struct(F.substring("prefix", level + 1, 1).alias("name"), "digest")).alias("parts"), F.sum("n").alias("n"))


def _digested(rows: DataFrame) -> DataFrame:
    return rows.select("prefix", F.sha2(_lines("parts"), 256).alias("digest"), "n")


def nodes_of(leaves: DataFrame, depth: int) -> DataFrame:
    """All nodes of a tree; the root has the empty prefix. An empty registry has none. Repeated leaves count once; an id
    with two digests has both."""
    level = checkpointed(_digested(_buckets(leaves, depth)))
    out = level
    for k in reversed(range(depth)):
        level = checkpointed(_digested(_above(level, k)))
        out = out.unionByName(level)
    return out


def updated(nodes: DataFrame, leaves: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """The nodes after the assets ``changed`` (id) came, went or got another digest; ``leaves`` are those now. Only buckets
    that have a changed asset are read, and only nodes above these are made again."""
    touched = changed.select(F.substring(place(F.col("id")), 1, depth).alias("prefix")).distinct()
    near = leaves.withColumn("_prefix", F.substring(place(F.col("id")), 1, depth)).join(touched.withColumnRenamed("prefix", "_prefix"), "_prefix", "left_semi").drop("_prefix")
    level = checkpointed(_digested(_buckets(near, depth)))
    fresh, gone = level, touched
    for k in reversed(range(depth)):
        above = touched.select(F.substring("prefix", 1, k).alias("prefix")).distinct()
        siblings = nodes.where(F.length("prefix") == k + 1).join(touched, "prefix", "left_anti").withColumn("_up", F.substring("prefix", 1, k)).join(above.withColumnRenamed("prefix", "_up"), "_up", "left_semi").drop("_up")
        level = checkpointed(_digested(_above(siblings.unionByName(level), k)))
        fresh, gone, touched = fresh.unionByName(level), gone.unionByName(above), above
    return nodes.join(gone, "prefix", "left_anti").unionByName(fresh)


def proofs(nodes: DataFrame, leaves: DataFrame, ids: DataFrame, depth: int) -> DataFrame:
    """(id, digest, path) of the asked ids that are leaves. What is read of the tree are the asked buckets and the nodes
    beside their ways up."""
    asked = leaves.join(ids.select("id").distinct(), "id", "left_semi").select("id", "digest", place(F.col("id")).alias("own")).distinct().withColumn("prefix", F.substring("own", 1, depth))
    star = lambda own: F.array_join(F.transform(F.array_sort("parts"), lambda x: F.concat_ws(":", x["name"], F.when(own(x), F.lit("*")).otherwise(x["digest"]))), "\n")
    prefixes = asked.select("prefix").distinct()
    near = leaves.withColumn("_prefix", F.substring(place(F.col("id")), 1, depth)).join(prefixes.withColumnRenamed("prefix", "_prefix"), "_prefix", "left_semi").drop("_prefix")
    out = asked.join(_buckets(near, depth).drop("n"), "prefix").withColumn("path", F.array(star(lambda x: (x["name"] == F.col("own")) & (x["digest"] == F.col("digest"))))).drop("parts")
    for k in reversed(range(depth)):
        above = prefixes.select(F.substring("prefix", 1, k).alias("up")).distinct()
        beside = nodes.where(F.length("prefix") == k + 1).withColumn("up", F.substring("prefix", 1, k)).join(above, "up", "left_semi")
        parts = beside.groupBy("up").agg(F.collect_list(F.struct(F.substring("prefix", k + 1, 1).alias("name"), "digest")).alias("parts"))
        digit = F.substring("own", k + 1, 1)
        out = out.withColumn("up", F.substring("prefix", 1, k)).join(parts, "up").withColumn("path", F.concat("path", F.array(star(lambda x: x["name"] == digit)))).drop("parts", "up")
        prefixes = above.withColumnRenamed("up", "prefix")
    return out.select("id", "digest", "path")


def proven_root(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda h, lines: F.sha2(F.replace(lines, F.lit("*"), h), 256))


def names_place(asset: Column, path: Column) -> Column:
    """Whether the path's bucket has the asset's place as the one to prove: a proof of one asset proves no other."""
    return F.coalesce(F.contains(F.get(path, 0), F.concat(place(asset), F.lit(":*"))), F.lit(False))


def forged(nodes: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """(prefix, id) of the leaves in buckets that do not have the digest that the tree has, or that one of the two lacks."""
    now = _digested(_buckets(leaves, depth)).select("prefix", F.col("digest").alias("now"))
    wrong = nodes.where(F.length("prefix") == depth).join(now, "prefix", "full_outer").where(~F.col("digest").eqNullSafe(F.col("now"))).select("prefix")
    placed = leaves.select(F.substring(place(F.col("id")), 1, depth).alias("prefix"), "id")
    return wrong.join(placed, "prefix", "left")


def root(nodes: DataFrame) -> DataFrame:
    """(n_assets, root), one row; the root of an empty registry is null."""
    top = nodes.where("prefix = ''")
    return top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_assets"), F.max("digest").alias("root"))
