"""Exact nearest neighbours of 64-bit hashes, by tables of their parts and a growing radius.

Bits are cut into m parts of about equal width, and each distinct registered hash stands in m tables, under the value of
each part. In round s a query looks up, in every table, all values at s bits from its own part. After rounds 0 to s it has
met every hash within m (s + 1) - 1 bits, as in a nearer hash some part differs by s bits at most; if it has found enough
within that radius, what it has is proven and it is done. What is not proven after the last round meets all hashes, in
blocks. So near neighbours cost a few look-ups, far ones a scan, and both are exact, ties by id included.

A pair is looked at in one table and round only, the first one that gives its least part distance, so nothing needs to be
made distinct. Only distinct hashes meet, each with its number of ids up to k and its least id: whatever is among the k
nearest ids belongs to one of the k hashes that come first by (distance, least id). Ids come in at the end.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import delete, new_folder
from .retrieval import nearest

#: Values of one part that a query looks up in the last round.
PROBES = 700


def _edges(n: int) -> list[tuple[int, int]]:
    """Parts of about log2 n bits, 16 at least: so many that a value of a part has few of the n hashes."""
    m = max(1, min(4, 64 // max(16, math.ceil(math.log2(max(n, 2))))))
    cuts = [64 * i // m for i in range(m + 1)]
    return list(itertools.pairwise(cuts))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _part(h: Column, a: int, b: int) -> Column:
    return h.bitwiseAND(F.lit(_signed(((1 << (b - a)) - 1) << a)))


def _first_sight(x: Column, parts: list[tuple[int, int]]) -> Column:
    """struct(s, table) of the least distance of a part in x, the xor of a pair, and the first part that has it."""
    return F.array_min(F.array(*[F.struct(F.bit_count(_part(x, a, b)).alias("s"), F.lit(i).alias("table")) for i, (a, b) in enumerate(parts)]))


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` hashes of each query that come first by (distance, least id); a map-side limit comes first."""
    order = W.partitionBy("query").orderBy("distance", "least")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


class Search:
    """A search for the k nearest of each query (id, hash); with ``others``, queries are rows of the registry, and none is a
    neighbour of itself. Null hashes and ids take no part.

    ``result()`` has (candidate, parent, distance, rank), ``report()`` one row of counts. Tables of the rounds are written
    to the shared folder; ``clear()`` deletes them when the result has been used."""

    def __init__(self, queries: DataFrame, registry: DataFrame, k: int = 10, others: bool = False):
        self.k, self.others, self.most = k, others, k + 1 if others else k
        self.spark = queries.sparkSession
        self.folder = new_folder(self.spark, "hamming")
        whole = lambda df: df.where("hash IS NOT NULL AND id IS NOT NULL").select("id", "hash").distinct()
        self.queries = self._kept(whole(queries), "queries")
        by = W.partitionBy("hash").orderBy("id")
        ids = whole(registry).withColumn("at", F.row_number().over(by)).where(F.col("at") <= self.most)
        self.ids = self._kept(ids, "ids")
        self.hashes = self._kept(self.ids.groupBy("hash").agg(F.min("id").alias("least"), F.max("at").alias("n")), "hashes")
        self.n_hashes = self.hashes.count()
        self.parts = _edges(self.n_hashes)
        self._search()

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("errorifexists").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def _probes(self, asked: DataFrame, s: int) -> DataFrame:
        """(query, table, value) of all values at s bits from each part."""
        flips = [F.lit(_signed(sum(1 << bit for bit in bits))) for a, b in self.parts for bits in itertools.combinations(range(a, b), s)]
        owner = [i for i, (a, b) in enumerate(self.parts) for _ in range(math.comb(b - a, s))]
        each = F.arrays_zip(F.array(*map(F.lit, owner)).alias("table"), F.array(*flips).cast("array<bigint>").alias("flip"))
        out = asked.select("query", F.explode(each).alias("p")).select("query", "p.table", F.col("p.flip").alias("flip"))
        own = F.lit(None).cast("bigint")
        for i, (a, b) in enumerate(self.parts):
            own = F.when(F.col("table") == i, _part(F.col("query"), a, b)).otherwise(own)
        return out.select("query", "table", own.bitwiseXOR(F.col("flip")).alias("value"))

    def _search(self) -> None:
        parts, most = self.parts, self.most
        stood = F.array(*[F.struct(F.lit(i).alias("table"), _part(F.col("hash"), a, b).alias("value")) for i, (a, b) in enumerate(parts)])
        tables = self._kept(self.hashes.select("hash", "least", "n", F.explode(stood).alias("t")).select("hash", "least", "n", "t.*"), "tables")
        asked = self.queries.select(F.col("hash").alias("query")).distinct()
        best, self.rounds, self.proven = None, [], []
        s = 0
        while s == 0 or math.comb(max(b - a for a, b in parts), s) <= PROBES:
            met = self._probes(asked, s).join(tables, ["table", "value"])
            x = F.col("query").bitwiseXOR(F.col("hash"))
            sight = _first_sight(x, parts)
            seen = met.where((sight["s"] == s) & (sight["table"] == F.col("table"))).select("query", "hash", "least", "n", F.bit_count(x).cast("bigint").alias("distance"))
            counted = seen.groupBy("query").agg(F.count("*").alias("met"))
            self.rounds.append(self._kept(counted, f"met{s}"))
            found = _best(seen if best is None else seen.unionByName(best.join(asked, "query", "left_semi")), most)
            best = self._kept(found, f"best{s}")
            radius = len(parts) * (s + 1) - 1
            enough = best.where(F.col("distance") <= radius).groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") >= most).select("query")
            enough = self._kept(enough, f"proven{s}")
            self.proven.append(best.join(enough, "query", "left_semi"))
            asked = self._kept(asked.join(enough, "query", "left_anti"), f"asked{s + 1}")
            self.left = asked.count()
            s += 1
            if not self.left:
                break
        self.asked = asked

    def result(self) -> DataFrame:
        done = self.proven[0]
        for more in self.proven[1:]:
            done = done.unionByName(more)
        near = done.select("query", "hash", "distance").join(self.ids.select("hash", F.col("id").alias("parent")), "hash").select("query", "parent", "distance")
        order = W.partitionBy("candidate").orderBy("distance", "parent")
        own = self.queries.select(F.col("id").alias("candidate"), F.col("hash").alias("query"))
        # A query's rows are few: those of the hashes that come first, each with its first ids.
        first = W.partitionBy("query").orderBy("distance", "parent")
        near = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= self.most).drop("_r")
        out = own.join(near, "query").select("candidate", "parent", "distance")
        if self.left:
            rest = own.join(self.asked, "query", "left_semi").select(F.col("candidate").alias("id"), F.col("query").alias("hash"))
            out = out.unionByName(nearest(rest, self.ids.select("id", "hash"), self.most).select("candidate", "parent", "distance"))
        if self.others:
            out = out.where("candidate <> parent")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def report(self) -> DataFrame:
        """One row: n_queries and n_hashes (distinct ones), scanned (queries that met all hashes), compared (pairs) and share
        of all pairs."""
        met = self.rounds[0]
        for more in self.rounds[1:]:
            met = met.unionByName(more)
        n = self.queries.select("hash").distinct().agg(F.count("*").alias("n_queries"))
        compared = met.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"))
        both = n.crossJoin(compared)  # one row each
        scanned, hashes = F.lit(self.left).cast("bigint"), F.lit(self.n_hashes).cast("bigint")
        out = both.select("n_queries", hashes.alias("n_hashes"), scanned.alias("scanned"), (F.col("met") + scanned * hashes).alias("compared"))
        return out.withColumn("share", F.try_divide(F.col("compared"), F.col("n_queries") * F.col("n_hashes")))

    def clear(self) -> None:
        delete(self.spark, self.folder)
