"""Merkle manifest of a dataset, reduced by superblocks.

Leaves are digests of rows. Those of one key (a language, say) are numbered by an order; while several nodes of a key
remain, every ``fanout`` consecutive ones become the digest of their joined hexadecimal digests. What remains is the key's
subroot, and the subroots, in the order of their keys, give the root of the dataset likewise.

A superblock is a bucket of ``fanout ** levels`` consecutive nodes, which one call of pandas collapses to one node;
bucket roots are reduced in the same way until one node a key is left. So a shuffle does ``levels`` levels, no bucket
has more than that many rows, and a key with most rows has most buckets. Going down again, each bucket's nodes get their
own lower proofs, with the bucket's upper proof added: no proof is ever shuffled but one a bucket.

A path is an array with an entry for each level upwards: the digests of the node's run in their order, with ``*`` in
place of the node. So :func:`folded` needs built-in functions only.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut, drop

FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*columns: Column) -> Column:
    """The SHA-256 of the columns' values in turn, each as its UTF-8 byte count, ``:`` and value, or ``-`` if null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, run: F.sha2(F.replace(run, F.lit("*"), h), 256))


def siblings(path: Column) -> Column:
    """All other nodes of the runs along a path, joined."""
    return F.replace(F.array_join(path, ""), F.lit("*"), F.lit(""))


def _h(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _floors(nodes: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """A bucket's nodes level by level: ``levels`` upwards, or up to the only node where the bucket has all n of its key."""
    floors = [nodes]
    while len(floors) <= levels and (len(floors[-1]) > 1 or n > fanout**levels):
        last = floors[-1]
        floors.append([_h(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return floors


def _numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, str]:
    """``rows`` (key, ...) with at = 0, 1, ... in their key by ``order`` and n, the rows of the key. Rows go to ranges of
    (key, order), which are written; their places in there follow from the ranges' sizes. Equal rows are in any order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["key", *order, "_any"]
    dealt = rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_any")
    written, path = cut(dealt.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33).alias("_part")
    ranges = written.groupBy(part, "key").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("key").orderBy("_part")
    starts = ranges.select("_part", "key", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy("key")).alias("n"))
    return written.withColumn("_part", part).join(starts, ["_part", "key"]).withColumn("at", F.col("_id") - F.col("_first") + F.col("_before")).drop("_part", "_first", "_before", "_id"), path


def _bucketed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("at") / F.lit(fanout**levels)).cast("bigint"))


def _collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(key, at, n, node) of the bucket roots."""

    def collapse(key, bucket):
        n = int(bucket.n.iloc[0])
        floors = _floors(bucket.sort_values("at").node.tolist(), n, fanout, levels)
        return pd.DataFrame({"key": [key[0]], "at": [key[1]], "n": [-(-n // fanout**levels)], "node": floors[-1]})

    return _bucketed(nodes.select("key", "at", "n", "node"), fanout, levels).groupBy("key", "bucket").applyInPandas(collapse, "key string, at bigint, n bigint, node string")


def _expanded(nodes: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with path and the other columns of ``upper`` (key, at, path, ...), which has the bucket roots' paths."""
    given = [c for c in upper.columns if c not in ("key", "at", "path")]

    def expand(lower, above):
        lower = lower.sort_values("at", ignore_index=True)
        floors = _floors(lower.node.tolist(), int(lower.n.iloc[0]), fanout, levels)
        rest = list(above.path.iloc[0])
        runs = [[floor[i : i + fanout] for i in range(0, len(floor), fanout)] for floor in floors[:-1]]
        marked = [["".join([*run[:i], "*", *run[i + 1 :]]) for run in level for i in range(len(run))] for level in runs]
        paths = [[level[i // fanout**k] for k, level in enumerate(marked)] + rest for i in range(len(lower))]
        return lower.drop(columns="bucket").assign(path=paths, **{c: above[c].iloc[0] for c in given})

    kinds = ", ".join(f"`{c}` {t}" for c, t in [*nodes.dtypes, ("path", "array<string>"), *[x for x in upper.dtypes if x[0] in given]])
    left, right = _bucketed(nodes, fanout, levels), upper.withColumnRenamed("at", "bucket")
    return left.groupBy("key", "bucket").cogroup(right.groupBy("key", "bucket")).applyInPandas(expand, kinds)


def _stages(leaves: DataFrame, fanout: int, levels: int, name: str) -> list[tuple[DataFrame, str]]:
    """The tables of bucket roots, each of those before, until one node a key is left."""
    out, now = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        now, path = cut(_collapsed(now, fanout, levels), name)
        out.append((now, path))
        most = -(-most // fanout**levels)
    return out


def merkle_tree(rows: DataFrame, key_col: str, order_cols: list[str], leaf_col: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``rows`` with index (its place among the leaves of its key, from 0), subroot, root and path.

    Leaves are numbered in their key by ``order_cols`` (nulls first), then by their digests; rows that tie on all are equal
    leaves, and any order gives the same tree. Keys are ordered as UTF-8 bytes, null first and apart from the empty
    string. A lone leaf is its own subroot, a lone subroot the root; an empty table gives an empty result. Columns named
    like the new ones are replaced, others pass unchanged."""
    spark, new = rows.sparkSession, ("index", "subroot", "root", "path")
    names = {c: f"c{i}" for i, c in enumerate(rows.columns) if c not in new}
    key = F.coalesce(F.concat(F.lit(":"), F.col(f"`{key_col}`").cast("string")), F.lit("-"))
    order = {c: f"o{i}" for i, c in enumerate(order_cols)}
    inner = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[F.col(f"`{c}`").alias(n) for c, n in order.items()], key.alias("key"), F.col(f"`{leaf_col}`").alias("node"))
    numbered, _ = _numbered(inner, [*order.values(), "node"], "leaves")
    leaves = numbered.drop(*order.values())
    stages = _stages(leaves, fanout, levels, "buckets")
    tops = (stages[-1][0] if stages else leaves).select("key", "node")
    subroots, path = _numbered(tops.select(F.lit("").alias("key"), F.col("key").alias("own"), "node"), ["own"], "subroots")
    over = _stages(subroots, fanout, levels, "tops")
    # Down again: from the root to the subroots, and to the buckets of each stage.
    upper = (over[-1][0] if over else subroots).select("key", "at", F.expr("CAST(array() AS array<string>)").alias("path"), F.col("node").alias("root"))
    for below in [*[x[0] for x in over[:-1]][::-1], *([subroots] if over else [])]:
        upper = _expanded(below, upper, fanout, levels).select("key", "at", *(["own", "node"] if below is subroots else []), "path", "root")
    if not over:
        upper = upper.join(subroots.select("key", "at", "own", "node"), ["key", "at"])
    upper = upper.select(F.col("own").alias("key"), F.lit(0).cast("bigint").alias("at"), "path", F.col("node").alias("subroot"), "root")
    for below, _ in stages[:-1][::-1]:
        upper = _expanded(below, upper, fanout, levels).select("key", "at", "path", "subroot", "root")
    upper, _ = cut(upper, "paths")
    drop(spark, path, *[p for _, p in [*stages, *over]])
    out = _expanded(leaves, upper, fanout, levels) if stages else leaves.join(upper.drop("at"), "key")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("at").alias("index"), "subroot", "root", "path")


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", key_col: str = "lang", more: tuple[str, ...] = ()) -> DataFrame:
    """id, key, the columns ``more``, leaf (the digest of ``fields``), index, subroot, root and path of each row.

    ``folded(leaf_digest(...), path)`` of a row as it is now equals root only if no field has changed."""
    leaf = leaf_digest(*[F.col(f"`{c}`") for c in fields]).alias("leaf")
    return merkle_tree(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, key_col, *more]) if c != "leaf"], leaf), key_col, [id_col], "leaf")


def tamper_digests(docs: DataFrame) -> DataFrame:
    """Of each row of ``documents``: leaf, subroot, root, the digest of its proof, and what the proof gives for a row that
    is changed where 3 divides the CRC-32 of its id's digits, by lower-casing A-Z in its text."""
    fields = [F.col(c) for c in FIELDS]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest(*fields[:-1], F.translate("text", upper, upper.lower())))
    out = merkle_manifest(docs.select(*FIELDS, other.alias("other")), more=("other",)).withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
