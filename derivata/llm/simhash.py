"""SimHash fingerprints and all pairs of near ones, by vantage-point partitioning.

Fingerprints have 64 bits and link at up to ``RADIUS`` = 3 differing bits. They are cut into two halves of eight
nibbles. On each nibble, the Hamming distance to a vantage point's nibble is a pseudometric, and the nibbles' bits are
disjoint, so for two fingerprints x and y

    sum over nibbles |d(x, v) - d(y, v)|  <=  d(x, y)        (triangle bound)

If d(x, y) <= 3, one of the two halves differs in at most one bit. So each half makes a top level of shards, named by
its eight distances; a fingerprint lives in its own shard and also queries the shards whose distances are off by one
in one place, as only these can overlap its ball of radius one there. Each pair visits in one direction only.

Every shard is then searched by a vantage-point tree over the nibbles of the other half: a level branches by the
distance on one nibble, queries go into every branch that what is left of their radius allows, and branches that the
bound excludes are pruned. Leaves of more than ``LEAF`` pairs branch on, by other vantage points with the whole radius.
What meets in a leaf is compared exactly. All shards of a task go down the tree together, a level at a time. With very
many fingerprints, the upper levels of the tree are part of the shards' names, so that shards stay small.

Only distinct fingerprints are compared, so copies cost nothing; what leaves a task is a spanning forest of its links,
never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, drop
from .components import components, contract
from .words import LOWER, joined, released, slices, spans, text_buffers

RADIUS = 3
SHINGLE = 3
SEED = 42
VANTAGE = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
#: Pairs compared at a time, pairs in a leaf that is not split, and shingles hashed at a time.
BLOCK, LEAF, SHINGLES = 1 << 20, 1 << 12, 1 << 16
#: Fingerprints, on the average, of which each level of the tree above the shards takes a fifth.
MANY = 1 << 26
#: Visits that a task searches at a time, if they are of several shards.
HELD = 200_000
_NIBBLE = np.bitwise_count(np.arange(16, dtype=np.uint8)).astype(np.int64)


def fingerprints(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One uint64 for each document: the majority of its shingles' XXH64 bits; zero without words."""
    buf = LOWER[buf]
    starts, ends, first = spans(buf, off)
    n_words = np.diff(first)
    out = np.zeros(len(n_words), np.uint64)
    if not len(starts):
        return out
    text, at = joined(buf, starts, ends)
    data, stops = memoryview(text), at + ends - starts
    n = np.where(n_words > 0, np.maximum(n_words - SHINGLE + 1, 1), 0)
    before = np.cumsum(n) - n
    total = np.zeros((len(n), 64), np.int64)
    digest, seed = xxhash.xxh64_intdigest, SEED
    for begin in range(0, int(n.sum()), SHINGLES):
        shingle = np.arange(begin, min(begin + SHINGLES, int(n.sum())))
        doc = np.searchsorted(before + n, shingle, "right")
        inside = shingle - before[doc]
        lo = first[:-1][doc] + inside
        hi = np.minimum(lo + SHINGLE, first[1:][doc]) - 1
        h = np.fromiter((digest(data[a:b], seed) for a, b in zip(at[lo].tolist(), stops[hi].tolist(), strict=True)), np.uint64, len(lo))
        # Bits as bytes, eight to a word: up to 255 shingles add up without a carry between the bytes.
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        cuts = np.flatnonzero((inside % 255 == 0) | (np.arange(len(lo)) == 0))
        np.add.at(total, doc[cuts], np.add.reduceat(bits, cuts, axis=0).view(np.uint8))
    have = n > 0
    out[have] = np.packbits(2 * total[have] > n[have][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches):
    with released():
        yield from (_fingerprint_rows(batch) for whole in batches for batch in slices(whole, "text"))


def _fingerprint_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    fp = fingerprints(*text_buffers(batch.column(batch.schema.get_field_index("text"))))
    keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(fp.view(np.int64))], names=[*(batch.schema.names[i] for i in keep), "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` (k, [...], text) without text, and fp bigint (the 64 bits)."""
    kinds = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(_fingerprint_batches, f"{kinds}, fp bigint")


def _nibble(fp: np.ndarray, v: int, i: int) -> np.ndarray:
    """Distance to a vantage point on one nibble."""
    return _NIBBLE[(((fp.view(np.uint64) ^ VANTAGE[v]) >> np.uint64(4 * i)) & np.uint64(15)).astype(np.int64)]


def _other(half: int) -> range:
    return range(8 * (1 - half), 8 * (1 - half) + 8)


def _branches(d: np.ndarray, left: np.ndarray):
    """(rows, branch, what is left of their radius) for every branch of five that rows at distance d may enter."""
    for step in range(-RADIUS, RADIUS + 1):
        rows = np.flatnonzero((left >= abs(step)) & (d + step >= 0) & (d + step <= 4))
        if len(rows):
            yield rows, d[rows] + step, left[rows] - abs(step), step == 0


def _visits(levels: int):
    """Rows (shard, fp, left, home): each fingerprint's own shards and those that its ball overlaps, with what is left
    of the radius there. Of two shards of one half, the lesser one's fingerprints visit the other."""

    def visits(fp: np.ndarray, half: int):
        shard, steps = np.zeros(len(fp), np.int64), []
        for k in range(8):
            d = _nibble(fp, 0, 8 * half + k)
            shard = shard * 5 + d
            steps.append((d, 5 ** (7 - k)))
        parts = [(shard, fp, np.full(len(fp), RADIUS), np.ones(len(fp), bool))]
        for d, size in steps:
            up = d < 4
            parts.append((shard[up] + size, fp[up], np.full(int(up.sum()), RADIUS - 1), np.zeros(int(up.sum()), bool)))
        shard, fp, left, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        shard += half * 5**8
        for i in _other(half)[:levels]:
            parts = [(shard[rows] * 5 + branch, fp[rows], rest, home[rows] & own) for rows, branch, rest, own in _branches(_nibble(fp, 0, i), left)]
            shard, fp, left, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        return shard, fp, left, home

    def run(batches):
        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(column), 1 << 16):
                for half in range(2):
                    shard, fp, left, home = visits(column[lo : lo + (1 << 16)], half)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp), pa.array(left.astype(np.int8)), pa.array(home), pa.array(np.full(len(fp), half, np.int8))], names=["shard", "fp", "left", "home", "half"])

    return run


class _Links:
    """Links found so far, shortened to a spanning forest now and then."""

    def __init__(self):
        self.u, self.v, self.n = [], [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.u.append(u)
            self.v.append(v)
            self.n += len(u)
            if self.n > 4 * BLOCK:
                u, v = self.shortened()
                self.u, self.v, self.n = [u], [v], 0

    def shortened(self):
        if not self.u:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return contract(np.concatenate(self.u), np.concatenate(self.v))


def _compare(homes, home_node, queries, query_node, links: _Links) -> None:
    """Compare every query with the homes of its leaf, a block of pairs at a time; homes are sorted by leaf."""
    lo, hi = np.searchsorted(home_node, query_node, "left"), np.searchsorted(home_node, query_node, "right")
    total = np.cumsum(hi - lo)
    at = 0
    while at < len(queries):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
        n = hi[at:to] - lo[at:to]
        x = np.repeat(queries[at:to], n)
        y = homes[np.arange(int(n.sum())) + np.repeat(lo[at:to] - (np.cumsum(n) - n), n)]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS
        links.add(x[near], y[near])
        at = to


def _level(homes, home_node, queries, query_node, left, v: int, i: int):
    """One level of the tree: homes by their distance on nibble i, queries into the branches that have homes."""
    keys = home_node * 5 + _nibble(homes, v, i)
    known, home_node = np.unique(keys, return_inverse=True)
    order = np.argsort(home_node, kind="stable")
    parts = []
    for rows, branch, rest, _ in _branches(_nibble(queries, v, i), left):
        key = query_node[rows] * 5 + branch
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        there = known[at] == key
        parts.append((queries[rows[there]], at[there], rest[there]))
    queries, query_node, left = (np.concatenate(x) for x in zip(*parts, strict=True))
    return homes[order], home_node[order], queries, query_node, left


def search(shard, fp, left, home, half: int, levels: int, links: _Links) -> int:
    """Search whole shards of one half by the tree below their names; how many pairs met in a leaf."""
    known, home_node = np.unique(shard[home], return_inverse=True)
    if not len(known):
        return 0
    order, node = np.argsort(home_node, kind="stable"), np.minimum(np.searchsorted(known, shard), len(known) - 1)
    there = known[node] == shard
    state = fp[home][order], home_node[order], fp[there], node[there], left[there].astype(np.int64)
    for i in _other(half)[levels:]:
        state = _level(*state, 0, i)
    met, v = 0, 1
    while True:
        homes, home_node, queries, query_node, left = state
        n_home, n_query = np.bincount(home_node), np.bincount(query_node, minlength=int(home_node[-1]) + 1)
        full = (n_home * n_query > LEAF) & (v < len(VANTAGE))
        few = ~full[query_node]
        met += int((n_home * n_query)[~full].sum())
        own = ~full[home_node]
        _compare(homes[own], home_node[own], queries[few], query_node[few], links)
        if not full.any():
            return met
        state = homes[~own], home_node[~own], queries[~few], query_node[~few], np.full(int((~few).sum()), RADIUS)
        for i in range(16):
            state = _level(*state, v, i)
        v += 1


def _pairs(levels: int):
    """Rows (u, v): a spanning forest of the links of each task's shards, which come one after another."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        links, most = _Links(), HELD

        def done(table: pa.Table):
            shard, fp, left, home, part = (table.column(n).to_numpy() for n in ("shard", "fp", "left", "home", "half"))
            for half in range(2):
                mine = part == half
                search(shard[mine], fp[mine], left[mine], home[mine], half, levels, links)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < most:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("half").to_numpy().astype(np.int64) << 60 | table.column("shard").to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                done(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
            most = max(HELD, 2 * (table.num_rows - last))
        if held:
            done(pa.Table.from_batches(held))
        u, v = links.shortened()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def near_roots(distinct: DataFrame, levels: int | None = None) -> tuple[DataFrame, str]:
    """(node, root) of the fingerprints (one column, fp) that link to a lesser one, over any number of steps, as a
    table, and its path.

    ``levels``, 0 to 8, is how many levels of the tree are part of the shards' names; by default, it follows the number
    of fingerprints. It changes no link."""
    spark = distinct.sparkSession
    if levels is None:
        count = distinct.count()
        levels = next((k for k in range(8) if count <= MANY * 5**k), 8)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    visits = distinct.select("fp").repartition(n).mapInArrow(_visits(levels), "shard bigint, fp bigint, left tinyint, home boolean, half tinyint")
    links = visits.repartition(n, "half", "shard").sortWithinPartitions("half", "shard").mapInArrow(_pairs(levels), "u bigint, v bigint")
    return components(links.where("u <> v"))


def _classes(docs: DataFrame, id_col: str, text_col: str):
    """(k, t, fp) of every row, and (fp, root) of every distinct fingerprint; both as tables."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.xxhash64(F.col(f"`{text_col}`"), F.col(f"`{text_col}`").isNull()).alias("t"), F.col(f"`{text_col}`").alias("text"))
    found, _ = cut(with_fingerprints(rows), "fingerprints")
    distinct, path = cut(found.select("fp").distinct(), "distinct")
    roots, roots_path = near_roots(distinct)
    classes, _ = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    drop(spark, path, roots_path)
    return found, classes


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, fingerprint (16 lowercase hex digits) and component_id, the smallest
    id among all that it reaches over links of ``RADIUS`` bits or fewer.

    Nulls and texts without words have fingerprint zero and link like others. Null ids take part but are never a
    component_id unless a component has no other. Repeated rows each give a row. Other columns don't matter."""
    found, classes = _classes(docs, id_col, text_col)
    least = found.groupBy("fp").agg(F.min("k").alias("k")).join(classes, "fp").groupBy("root").agg(F.min("k").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select(F.col("k").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (nulls last; then by text; one of equal rows).
    All columns stay as they are."""
    found, classes = _classes(docs, id_col, text_col)
    order = F.struct(F.col("k").isNull().alias("n"), F.col("k").alias("k"), F.col("t").alias("t"))
    firsts = found.groupBy("fp").agg(F.min(order).alias("o")).join(classes, "fp").groupBy("root").agg(F.min("o").alias("o"))
    firsts = firsts.select(F.col("o.k").alias("_k"), F.col("o.t").alias("_t"))
    mark = F.xxhash64(F.col(text_col), F.col(text_col).isNull())
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], mark.alias("_mark"))
    key = names[id_col]
    kept = inner.join(firsts.hint("shuffle_hash"), inner[key].eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_t")), "left_semi")
    return kept.dropDuplicates([key, "_mark"]).select(*[F.col(n).alias(c) for c, n in names.items()])
