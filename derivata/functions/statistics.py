"""Rates, order statistics and exact binomial intervals."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def rate(k: Column, n: Column) -> Column:
    """k / n; null where n is 0."""
    return F.try_divide(k.cast("double"), n.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))


def nearest_rank(ordered: Column, p: float) -> Column:
    """The element at p * (n - 1), rounded half to even, of a sorted array; null if empty."""
    at = F.rint(F.lit(p) * (F.size(ordered) - 1)).cast("int") + 1
    return F.when(F.size(ordered) > 0, F.try_element_at(ordered, at))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def _beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


@functools.lru_cache(1 << 16)
def binomial_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float] | None:
    """Clopper-Pearson bounds; None for n = 0, exactly 0 and 1 at the edges."""
    if not n:
        return None
    tail = (1 - level) / 2
    return (_beta_quantile(tail, k, n - k + 1) if k else 0.0, _beta_quantile(1 - tail, k + 1, n - k) if k < n else 1.0)


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def binomial_interval_column(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Bounds for columns of counts; for aggregated rows, of which there are few."""
    found = [binomial_interval(int(x), int(y)) if pd.notna(x) and pd.notna(y) else None for x, y in zip(k, n, strict=True)]
    return pd.DataFrame({"low": [f[0] if f else None for f in found], "high": [f[1] if f else None for f in found]}, dtype="float64")
