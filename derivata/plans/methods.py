"""Registries: matchers by method, and the leads that a check reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import alignment, features


@dataclass(frozen=True)
class Matcher:
    """How a method ranks the whole registry (coarse), and verifies what it ranked (pairs in, scores out)."""

    method: str
    coarse: Callable[[Column, Column], Column]
    verify: Callable[[DataFrame], DataFrame] | None


def _frame_hash(pairs: DataFrame) -> DataFrame:
    score = alignment.slide_score(F.col("candidate"), F.col("source"))
    return pairs.withColumn("score", score).withColumn("status", F.when(F.col("score").isNull(), "not_evaluated").otherwise("evaluated"))


def _zero_if_missing(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.0))


MATCHERS = {
    m.method: m
    for m in (
        Matcher("V-A", lambda c, s: _zero_if_missing(alignment.slide_score(c, s)), _frame_hash),
        Matcher("V-B", alignment.coarse_score, alignment.warped),
        Matcher("V-C", features.descriptor_support, features.geometric_scores),
        Matcher("A-chromaprint", lambda c, s: _zero_if_missing(alignment.bits.score32(alignment.slide32(c, s)["total"] / F.size(c))), alignment.fingerprint_score),
        Matcher("embedding", lambda c, s: F.lit(0.0), None),
        Matcher("transcript", lambda c, s: F.lit(0.0), None),
    )
}


def verify(method: str, pairs: DataFrame) -> DataFrame:
    """``pairs`` with score and status by a method; methods without a verifier are not evaluated."""
    matcher = MATCHERS.get(method)
    if matcher is None:
        raise ValueError(f"unknown method {method!r}")
    if matcher.verify is None:
        return pairs.withColumns({"score": F.lit(None).cast("double"), "status": F.lit("not_evaluated")})
    return matcher.verify(pairs)


def leads(scores: DataFrame, methods: tuple[str, ...] = ("V-C", "A-chromaprint"), most: int = 5, blocks: int = 40) -> DataFrame:
    """The first pairs of each candidate and method with a positive score, with few blocks each, and their position among
    all of the candidate's: by score, then parent, then method."""
    order = W.partitionBy("candidate", "method").orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "parent")
    first = scores.where(F.col("method").isin(*methods)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    among = W.partitionBy("candidate").orderBy(F.desc("score"), "parent", "method")
    return first.where("score > 0").withColumns({"blocks": F.slice("blocks", 1, blocks), "position": F.row_number().over(among)})


def valid_intervals(intervals: Column, duration: Column) -> Column:
    """Whether all intervals are finite, and 0 <= a < b <= duration."""
    return F.coalesce(F.forall(intervals, lambda x: ~F.isnan(x["a"]) & ~F.isnan(x["b"]) & (x["a"] >= 0) & (x["a"] < x["b"]) & (x["b"] <= duration)), F.lit(False))


def valid_review(state: Column, text: Column) -> Column:
    return F.coalesce(state.isin("reviewed_support", "insufficient", "ambiguous") & (F.trim(text) != ""), F.lit(False))


def valid_period(start: Column, end: Column) -> Column:
    return F.coalesce(end > start, F.lit(False))
