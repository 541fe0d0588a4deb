"""Interval algebra over arrays of struct<a: double, b: double>; all built-in, folded inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import let

PAIR = "struct<a:double,b:double>"


def empty() -> Column:
    return F.array().cast(f"array<{PAIR}>")


def merge(intervals: Column, gap: float | Column = 0.0) -> Column:
    """Sorted union; intervals that touch, or lie within ``gap``, become one."""
    gap = gap if isinstance(gap, Column) else F.lit(float(gap))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        apart = F.concat(done, F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"))))
        return F.when((F.size(done) > 0) & (x["a"] - F.try_element_at(done, F.lit(-1))["b"] <= gap), joined).otherwise(apart)

    return F.aggregate(F.array_sort(intervals), empty(), step)


def total(intervals: Column) -> Column:
    """Sum of lengths, overlaps counted as often as they occur."""
    return F.aggregate(intervals, F.lit(0.0), lambda s, x: s + (x["b"] - x["a"]))


def overlap(left: Column, right: Column) -> Column:
    """Length common to two interval sets; each is merged first."""
    shared = lambda x, y: F.greatest(F.lit(0.0), F.least(x["b"], y["b"]) - F.greatest(x["a"], y["a"]))
    add = lambda s, x: s + x
    each = lambda x, r: F.aggregate(F.transform(r, lambda y: shared(x, y)), F.lit(0.0), add)
    return let(merge(right), lambda r: F.aggregate(F.transform(merge(left), lambda x: each(x, r)), F.lit(0.0), add))


def iou(claimed: Column, truth: Column) -> Column:
    """Intersection over union; both empty 1, one empty 0."""
    common = overlap(claimed, truth)
    return (
        F.when((F.size(claimed) == 0) & (F.size(truth) == 0), F.lit(1.0))
        .when((F.size(claimed) == 0) | (F.size(truth) == 0), F.lit(0.0))
        .otherwise(F.coalesce(F.try_divide(common, total(merge(claimed)) + total(merge(truth)) - common), F.lit(0.0)))
    )


def start_error(claimed: Column, truth: Column) -> Column:
    """Distance of the first starts; null if either is empty."""
    first = lambda x: F.array_min(F.transform(x, lambda y: y["a"]))
    return F.abs(first(claimed) - first(truth))


def end_error(claimed: Column, truth: Column) -> Column:
    last = lambda x: F.array_max(F.transform(x, lambda y: y["b"]))
    return F.abs(last(claimed) - last(truth))


def fragmentation_error(claimed: Column, truth: Column) -> Column:
    return F.abs(claimed - truth)


def false_continuous(claimed: Column, truth: Column) -> Column:
    """One fragment claimed where the truth has several."""
    return (truth > 1) & (claimed <= 1)


def padding_inflation(claimed: Column, truth: Column) -> Column:
    """Claimed over true duration, unmerged; null without true duration."""
    return F.when(total(truth) > 0, total(claimed) / total(truth))


def merge_blocks(blocks: Column, source_gap: float = 1.25, candidate_gap: float = 0.01) -> Column:
    """Join aligned blocks (struct<source, candidate>) in their order where both seams are close."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = (F.size(done) > 0) & (F.abs(last["source"]["b"] - x["source"]["a"]) <= source_gap) & (F.abs(last["candidate"]["b"] - x["candidate"]["a"]) < candidate_gap)
        source = F.struct(last["source"]["a"].alias("a"), F.greatest(last["source"]["b"], x["source"]["b"]).alias("b"))
        candidate = F.struct(last["candidate"]["a"].alias("a"), x["candidate"]["b"].alias("b"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(source.alias("source"), candidate.alias("candidate"))))
        return F.when(near, joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(blocks, F.array().cast(f"array<struct<source:{PAIR},candidate:{PAIR}>>"), step)
