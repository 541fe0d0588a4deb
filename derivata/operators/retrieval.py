"""Exact and similarity retrieval: candidates against a registry."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordinals import checkpointed

HASH_BITS = 64
#: Queries in a block, and registered hashes in a pack: what a worker compares at one time.
BLOCK, PACK = 4096, 1 << 16
#: Blocks of queries whose bests a worker holds.
HELD = 64
#: Rows of a side of a banded join in a task, on the average.
JOINED = 1 << 19


def ranked(scores: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "parent") -> DataFrame:
    """The k best rows of each group, best first; missing scores count as -1, ties go by ``tie``."""
    order = W.partitionBy(*by).orderBy(F.coalesce(score, F.lit(-1.0)).desc(), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def margins(top: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """One row a group: top parent, its score, and the margin to the next; null without a next."""
    order = W.partitionBy(*by).orderBy("rank")
    return (
        top.withColumn("margin", F.col(score) - F.lead(score).over(order))
        .where("rank = 1")
        .select(*by, F.col("parent").alias("top_parent"), F.col(score).alias("score"), "margin")
    )


def _packed(size: int):
    """Rows (ids, hashes) of up to ``size`` little-endian int64 values each, from rows (id, hash)."""

    def run(batches):
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in range(2)]))
                n += batch.num_rows
            if held and (batch is None or n >= size):
                both = np.concatenate(held, axis=1)
                stop = n if batch is None else n - n % size
                cuts = range(0, stop, size)
                yield pa.RecordBatch.from_arrays([pa.array([both[i, c : min(c + size, stop)].tobytes() for c in cuts], pa.binary()) for i in range(2)], names=["ids", "hashes"])
                held, n = [both[:, stop:]], n - stop

    return run


def _tops(k: int):
    """Rows (candidate, parent, distance): of each block of queries, the k nearest of the packs that it met here. The
    bests of up to ``HELD`` blocks are held; more are sent on, to be ranked with the rest."""

    def met(hashes, ids, h, best):
        d = np.bitwise_count((hashes ^ h).view(np.uint64)).astype(np.int64)
        near = d <= np.partition(d, k - 1)[k - 1] if len(d) > k else np.ones(len(d), bool)
        who, dist = np.concatenate([best[0], ids[near]]), np.concatenate([best[1], d[near]])
        order = np.lexsort((who, dist))[:k]
        return who[order], dist[order]

    def rows(held):
        found = [(q, *best) for (q_ids, _), bests in held.items() for q, best in zip(np.frombuffer(q_ids, "<i8").tolist(), bests, strict=True)]
        n = [len(x[1]) for x in found]
        columns = np.repeat(np.array([x[0] for x in found], np.int64), n), *(np.concatenate([x[i] for x in found]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["candidate", "parent", "distance"])

    def run(batches):
        held: dict[tuple[bytes, bytes], list] = {}
        for batch in batches:
            for *block, ids, hashes in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("q_ids", "q_hashes", "ids", "hashes")), strict=True):
                ids, hashes, queries = np.frombuffer(ids, "<i8"), np.frombuffer(hashes, "<i8"), np.frombuffer(block[1], "<i8")
                bests = held.get(tuple(block)) or [(np.zeros(0, np.int64),) * 2] * len(queries)
                held[tuple(block)] = [met(hashes, ids, h, best) for h, best in zip(queries, bests, strict=True)]
                if len(held) > HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return run


def nearest(queries: DataFrame, registry: DataFrame, k: int = 10, others: bool = False) -> DataFrame:
    """(candidate, parent, distance, rank): the k registered hashes nearest to each query (id, hash), ties by parent.
    With ``others``, queries are rows of the registry, and a query is no neighbour of itself.

    Queries are a stated set: blocks of ``BLOCK`` of them meet packs of ``PACK`` registered hashes, and each task keeps
    k rows a query, so the pairs themselves never become rows and nothing passes through the driver. Null hashes have no
    neighbours. Repeated queries give their neighbours once; a registered id counts once."""
    part = lambda df, size, names: df.where("hash IS NOT NULL AND id IS NOT NULL").select("id", "hash").distinct().mapInArrow(_packed(size), "ids binary, hashes binary").toDF(*names)
    blocks = part(queries, BLOCK, ("q_ids", "q_hashes"))
    packs = part(registry, PACK, ("ids", "hashes"))
    # Both sides are packed, a row each for thousands: a stated query set against all rows, in blocks.
    met = blocks.crossJoin(packs)
    found = met.mapInArrow(_tops(k + 1 if others else k), "candidate bigint, parent bigint, distance bigint")
    if others:
        found = found.where("candidate <> parent")
    order = W.partitionBy("candidate").orderBy("distance", "parent")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def banded_pairs(left: DataFrame, right: DataFrame, most: int = 3, bands: int = 6) -> DataFrame:
    """(left_id, right_id, distance) of all pairs within ``most`` < ``bands`` bits. Bits are cut into bands, and in each
    such pair ``bands - most`` of them are equal, so an equi-join by every choice of that many loses none; with more
    bands the keys are longer and fewer hashes share one. A pair counts in its first equal choice only."""
    if most >= bands:
        raise ValueError("needs more bands than differing bits")
    edges = [HASH_BITS * i // bands for i in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = [signed(sum(masks[i] for i in c)) for c in itertools.combinations(range(bands), bands - most)]

    def split(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.col("hash").bitwiseAND(F.lit(m)) for m in choices])
        return df.where("hash IS NOT NULL").select(F.col("id").alias(f"{name}_id"), F.col("hash").alias(f"{name}_hash"), F.posexplode(keys).alias("choice", "key"))

    # Rows of few bytes, so tasks are counted by rows: shuffled bytes say little of what sorting them takes.
    rows = max(left.count(), right.count()) * len(choices)
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // JOINED))
    dealt = lambda df: df.repartition(tasks, "choice", "key")
    pairs = dealt(split(left, "left")).join(dealt(split(right, "right")), ["choice", "key"])
    x = F.col("left_hash").bitwiseXOR(F.col("right_hash"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(choices)])
    return pairs.where((F.bit_count(x) <= most) & (F.col("choice") == first)).select("left_id", "right_id", F.bit_count(x).cast("bigint").alias("distance"))


def near_links(rows: DataFrame, most: int = 3, bands: int = 6) -> DataFrame:
    """(id, class_id, n_links, nearest) of rows (id, hash): the least id of the same hash, how many other ids are within
    ``most`` bits, and the least distance to another hash, or null. Only distinct hashes are paired, and each pair is
    counted, so copies make no pairs. Null hashes link to nothing and are classes of their own."""
    classes = checkpointed(rows.where("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("n")))
    named = classes.select(F.col("class_id").alias("id"), "hash")
    half = banded_pairs(named, named, most, bands).where("left_id <> right_id")
    sizes = classes.select(F.col("class_id").alias("right_id"), "n")
    linked = half.join(sizes, "right_id").groupBy(F.col("left_id").alias("class_id")).agg(F.sum("n").alias("beyond"), F.min("distance").alias("nearest"))
    known = classes.join(linked, "class_id", "left").select("hash", "class_id", (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), "nearest")
    out = rows.select("id", "hash").distinct().join(known, "hash", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "nearest")


def least_ids(assets: DataFrame, on: str) -> DataFrame:
    """(``on``, n, first, second): the number of ids of each value, the least one, and the next or null. No value's ids
    are gathered."""
    ids = assets.where(F.col(on).isNotNull()).select(on, "id")
    known = ids.groupBy(on).agg(F.countDistinct("id").alias("n"), F.min("id").alias("first"))
    beyond = ids.join(known.where("n > 1").select(on, "first"), on).where("id > first").groupBy(on).agg(F.min("id").alias("second"))
    return known.join(beyond, on, "left")


def exact_matches(candidates: DataFrame, assets: DataFrame, on: str = "sha256", others: bool = False) -> DataFrame:
    """(candidate, n_parents, first_parent) of candidates whose digest is registered. Assets of one digest are one row
    before the join, so a digest of many copies on both sides makes no pairs of them. With ``others``, candidates are
    assets themselves, and an asset is no parent of itself."""
    asked = candidates.select(F.col("id").alias("candidate"), on)
    if others:
        first = F.when(F.col("candidate") == F.col("first"), F.col("second")).otherwise(F.col("first"))
        return asked.join(least_ids(assets, on), on).where("n > 1").select("candidate", (F.col("n") - 1).alias("n_parents"), first.alias("first_parent"))
    known = assets.where(F.col(on).isNotNull()).groupBy(on).agg(F.countDistinct("id").alias("n_parents"), F.min("id").alias("first_parent"))
    return asked.join(known, on).select("candidate", "n_parents", "first_parent")


def unmatched(candidates: DataFrame, assets: DataFrame, on: str = "sha256", others: bool = False) -> DataFrame:
    """Candidates whose digest is not registered: those that dear comparisons are for. With ``others``, candidates are
    assets themselves, and an asset's own row does not count."""
    if others:
        return candidates.join(assets.groupBy(on).agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b"), on, "left_anti")
    return candidates.join(assets.select(on).distinct(), on, "left_anti")


def conflicts(assets: DataFrame, on: str = "sha256") -> DataFrame:
    """Digests registered under several ids, with their number and the least id; none of them wins."""
    return assets.groupBy(on).agg(F.countDistinct("id").alias("n_ids"), F.min("id").alias("first_id")).where("n_ids > 1")


def target_set(top: DataFrame, truth: DataFrame | None, k: int) -> DataFrame:
    """(candidate, parent) to verify: the k best of each method, and, where truth is given, the true parent."""
    out = top.where(F.col("rank") <= k).select("candidate", "parent")
    return (out.union(truth.select("candidate", "parent")) if truth is not None else out).distinct()


def recall_at(top: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, hits, n): true parents among the first k of the recorded ranking only."""
    best = truth.join(top.select("candidate", "parent", "rank"), ["candidate", "parent"], "left").groupBy("candidate").agg(F.min("rank").alias("rank"))
    wide = best.agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"k{k}").alias("hits"), F.col("n").alias("n")) for k in ks])))


def disposition(second_margin: Column, n_ranked: Column, least: float = 0.08) -> Column:
    """AMBIGUOUS if there are two or more and the first two are close."""
    return F.when((n_ranked >= 2) & (second_margin < least), F.lit("AMBIGUOUS")).otherwise(F.lit("ranked"))
