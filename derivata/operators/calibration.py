"""Calibration: score distributions, thresholds, curves, operating points and held-out fusion fits.

Curves come from sorted cumulative counts, not from every threshold against every sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordinals import running_sums
from ..functions.statistics import f1, nearest_rank, rate
from .decisions import AMBIGUITY_MARGIN, truth_of

#: Gates by modality: least true-positive rate, most false-positive rate.
GATES = {"V": (0.7, 0.02), "A": (0.75, 0.015), "F": (0.7, 0.015)}
DURATIONS = (5, 10, 15, 30)
WEIGHTS = (0.25, 0.5, 0.75)
GRID = 20


def distributions(samples: DataFrame, by: list[str]) -> DataFrame:
    """n, min, max, mean and nearest-rank p10, median, p90 of the scores by group and class; nulls are left out.

    The ranks come from running counts over distinct scores, so no group is gathered."""
    keys = [*by, "is_positive"]
    counts = samples.where("score IS NOT NULL").groupBy(*keys, "score").agg(F.count("*").alias("c")).withColumn("upto", F.col("c"))
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    ranked = running_sums(counts, keys, "score", ["upto"]).join(totals, keys)
    at = lambda p: F.rint(F.lit(p) * (F.col("n") - 1))
    pick = lambda p, name: F.min(F.when(F.col("upto") > at(p), F.col("score"))).alias(name)
    mean = (F.sum(F.col("score") * F.col("c")) / F.sum("c")).alias("mean")
    return ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"), mean, pick(0.1, "p10"), pick(0.5, "median"), pick(0.9, "p90"))


def overlap_hints(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, overlap_hint): how far the classes' scores overlap, by the share of negatives at or above the upper median of
    positives. From running counts, so no group is gathered."""
    keys = [*by, "is_positive"]
    scored = samples.where("score IS NOT NULL")
    counts = scored.groupBy(*keys, "score").agg(F.count("*").alias("c")).withColumn("upto", F.col("c"))
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    upper = running_sums(counts, keys, "score", ["upto"]).join(totals, keys).where("upto > floor(n / 2)").groupBy(*keys).agg(F.min("score").alias("m"), F.max("n").alias("n"))
    side = lambda yes, name: upper.where(F.col("is_positive") == yes).select(*by, F.col("m").alias(f"{name}_m"), F.col("n").alias(f"{name}_n"))
    both = samples.select(*by).distinct().join(side(True, "p"), by, "left").join(side(False, "q"), by, "left")
    high = counts.where("NOT is_positive").join(side(True, "p"), by).where("score >= p_m").groupBy(*by).agg(F.sum("c").alias("high"))
    share = rate(F.coalesce("high", F.lit(0)), F.col("q_n"))
    hint = (
        F.when(F.col("p_n").isNull() | F.col("q_n").isNull(), "insufficient_data")
        .when(F.col("p_m") <= F.col("q_m"), "inverted_or_collapsed")
        .otherwise(F.when(share > 0.4, "high_overlap").when(share > 0.15, "moderate_overlap").otherwise("low_overlap"))
    )
    return both.join(high, by, "left").select(*by, hint.alias("overlap_hint"))


def threshold_profile(samples: DataFrame, by: str = "modality", rule: str = "max_tpr_at_fpr_le_0.20", compat: bool = True) -> DataFrame:
    """One row a modality: threshold with its rule, counts of both classes, overlap hint, and whether it is usable (it
    has a threshold, and enough data). Groups without any score have no threshold."""
    n = samples.groupBy(by).agg(F.count_if(F.col("is_positive") & F.col("score").isNotNull()).alias("n_positive"), F.count_if(~F.col("is_positive") & F.col("score").isNotNull()).alias("n_negative"))
    scored = samples.where("score IS NOT NULL")
    chosen = select_threshold(threshold_curve(scored, [by]), [by], rule, compat).select(by, "threshold", F.col("rule").alias("selection_rule"))
    out = n.join(chosen, by, "left").join(overlap_hints(samples, [by]), by)
    return out.withColumn("usable", F.col("threshold").isNotNull() & (F.col("overlap_hint") != "insufficient_data"))


def candidate_thresholds(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold): a grid of 21, with the distinct scores of four decimals where there are three or more."""
    grid = samples.select(*by).distinct().select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: i / F.lit(float(GRID)))).alias("threshold"))
    own = samples.where("score IS NOT NULL").select(*by, F.round("score", 4).alias("threshold")).distinct()
    rich = own.groupBy(*by).agg(F.count("*").alias("n")).where("n >= 3").drop("n")
    return grid.union(own.join(rich, by).select(*by, "threshold")).distinct()


def threshold_curve(samples: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, tn, fn with rates for each candidate threshold (score >= threshold is positive)."""
    counts = samples.where("score IS NOT NULL").groupBy(*by, F.col("score").alias("x")).agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("q"))
    marks = candidate_thresholds(samples, by).select(*by, F.col("threshold").alias("x"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"), F.lit(True).alias("mark"))
    both = counts.withColumn("mark", F.lit(False)).unionByName(marks)
    totals = counts.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    out = running_sums(both.withColumnsRenamed({"p": "tp", "q": "fp"}), by, "x", ["tp", "fp"], descending=True).where("mark").join(totals, by)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("np") - F.col("tp"), F.col("nq") - F.col("fp")
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    return out.select(*by, F.col("x").alias("threshold"), "tp", "fp", fn.alias("fn"), tn.alias("tn"), recall.alias("tpr"), rate(fp, fp + tn).alias("fpr"), precision.alias("precision"), f1(precision, recall).alias("f1"))


RULES = ("max_tpr_at_fpr_le_0.20", "max_f1", "youden")


def select_thresholds(curve: DataFrame, by: list[str], rules: tuple[str, ...] = RULES, compat: bool = True) -> DataFrame:
    """The curve's row that each rule chooses for each group, with the rule's name; the lowest threshold wins ties. All
    rules are aggregated together, in one pass over the curve.

    ``compat`` ranks a false-positive rate of exactly 0 as 1, as the published results did; without it 0 is best."""
    if unknown := [r for r in rules if r not in RULES]:
        raise ValueError(f"unknown rule {unknown[0]!r}")
    fpr = F.coalesce(F.nullif("fpr", F.lit(0.0)), F.lit(1.0)) if compat else F.coalesce("fpr", F.lit(1.0))
    tpr = F.coalesce("tpr", F.lit(0.0))
    within = F.coalesce("fpr", F.lit(1.0)) <= 0.2
    first = {
        "max_tpr_at_fpr_le_0.20": [~within, F.when(within, -tpr).otherwise(F.coalesce("fpr", F.lit(1.0))), F.when(within, fpr).otherwise(-tpr)],
        "max_f1": [-F.coalesce("f1", F.lit(0.0))],
        "youden": [fpr - tpr],
    }
    named = {r: F.when(within, r).otherwise("fallback_min_fpr") if r.startswith("max_tpr") else F.lit(r) for r in rules}
    best = [F.min_by(F.struct(*[c for c in curve.columns if c not in by], named[r].alias("rule")), F.struct(*first[r], F.col("threshold"))).alias(f"_{i}") for i, r in enumerate(rules)]
    return curve.groupBy(*by).agg(*best).select(*by, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(rules))])))


def select_threshold(curve: DataFrame, by: list[str], rule: str = RULES[0], compat: bool = True) -> DataFrame:
    """:func:`select_thresholds` for one rule."""
    return select_thresholds(curve, by, (rule,), compat)


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` (with minimum_duration_s) that count at their duration, and what each adds from its score x on: tp, wrong,
    fp or amb; truth and avail say which denominators it is part of."""
    wide = rows.withColumn("truth", truth_of(F.col("method")))
    wide = wide.where((F.col("length_s") >= F.col("minimum_duration_s")) & (~F.col("method").startswith("V-") | ~F.col("truth") | (F.col("severity") != "harsh")))
    usable = (F.col("row_status") == "evaluated") & (F.col("status") == "evaluated") & F.col("score").isNotNull()
    processed = usable | (F.col("status") == "evaluated")
    long = F.coalesce("observed_duration_s", "length_s") >= F.col("minimum_duration_s")
    close = F.coalesce(F.col("margin") < AMBIGUITY_MARGIN, F.lit(False))
    right = F.col("top_parent").eqNullSafe(F.col("expected_parent"))
    live = usable & long
    return wide.withColumns({"x": F.col("score"), "tp": live & ~close & F.col("truth") & right, "wrong": live & ~close & F.col("truth") & ~right, "fp": live & ~close & ~F.col("truth"), "amb": live & close, "avail": processed & ~F.col("truth")})


_COUNTED = ("tp", "wrong", "fp", "amb")


def _denominators(judged: DataFrame, by: list[str]) -> DataFrame:
    return judged.groupBy(*by).agg(F.count_if("truth").alias("positive_denominator"), F.count_if("avail").alias("negative_available_denominator"), F.count_if(~F.col("truth")).alias("negative_expected_denominator"))


def operating_curve(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each method and each minimum duration, the counts at every threshold: below all scores, each score, above.

    A true positive needs the right parent and no ambiguity. Failed positives stay in the denominator; unavailable
    negatives show as the gap between the available and expected ones."""
    by = by or ["method", "minimum_duration_s"]
    wide = rows
    if "minimum_duration_s" not in rows.columns:
        wide = rows.withColumn("minimum_duration_s", F.explode(F.array(*[F.lit(d) for d in (1, 2, 3, *DURATIONS)])))
    judged = _judged(wide)
    ends = _denominators(judged, by)
    points = judged.where("x IS NOT NULL").groupBy(*by, "x").agg(*[F.count_if(c).alias(c) for c in _COUNTED])
    edges = ends.select(*by, F.explode(F.array(F.lit(-0.000001), F.lit(1.000001))).alias("x"), *[F.lit(0).cast("bigint").alias(c) for c in _COUNTED])
    summed = running_sums(points.unionByName(edges), by, "x", list(_COUNTED), descending=True).join(ends, by)
    return summed.select(
        *by,
        F.col("x").alias("threshold"),
        F.col("tp").alias("tp_correct_parent"),
        "fp",
        F.col("wrong").alias("wrong_parent"),
        F.col("amb").alias("ambiguous"),
        "positive_denominator",
        "negative_available_denominator",
        "negative_expected_denominator",
        rate(F.col("tp"), F.col("positive_denominator")).alias("tpr"),
        rate(F.col("fp"), F.col("negative_available_denominator")).alias("fpr"),
    )


def operating_points(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each method, the point at the smallest of the qualifying durations that passes its gates, there the one of
    greatest true-positive rate, then least false-positive rate, then greatest threshold. No row: none qualifies."""
    by = by or ["method"]
    kind = F.substring("method", 1, 1)
    gate = lambda i: F.coalesce(*[F.when(kind == k, F.lit(g[i])) for k, g in GATES.items()])
    ok = curve.where((F.col("tpr") >= gate(0)) & (F.col("fpr") <= gate(1)) & (F.col("negative_available_denominator") == F.col("negative_expected_denominator")) & F.col("minimum_duration_s").isin(*DURATIONS))
    best = W.partitionBy(*by).orderBy("minimum_duration_s", F.desc("tpr"), "fpr", F.desc("threshold"))
    return ok.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def chosen_method(points: DataFrame, methods: tuple[str, ...] = ("V-B", "V-C")) -> DataFrame:
    """The best of the methods that have an operating point: (method, threshold, minimum_duration_s, tpr, fpr)."""
    order = W.orderBy(F.desc("tpr"), "fpr", "method")
    few = points.where(F.col("method").isin(*methods))  # one row a method
    return few.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("method", "threshold", "minimum_duration_s", "tpr", "fpr")


def fusion_constituents(points: DataFrame, visual: tuple[str, ...] = ("V-B", "V-C"), audio: tuple[str, ...] = ("A-chromaprint",)) -> tuple[str, str, int] | None:
    """The visual and the audio method to fuse and the duration that both qualify at, from operating points (a row a
    method). None, as no fusion may be fitted, unless both modalities have one."""
    best = [chosen_method(points, methods).first() for methods in (visual, audio)]
    return None if None in best else (best[0].method, best[1].method, max(b.minimum_duration_s for b in best))


def fused_rows(labels: DataFrame, visual: DataFrame, audio: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Labelled candidates once a weight, with score, margin, top_parent and status of the fused ranking of the parents
    that both methods verified (candidate, parent, score). weight is the visual one's."""
    both = visual.select("candidate", "parent", F.col("score").alias("v")).join(audio.select("candidate", "parent", F.col("score").alias("a")), ["candidate", "parent"]).where("v IS NOT NULL AND a IS NOT NULL")
    each = F.explode(F.array(*map(F.lit, weights)))
    scored = both.withColumn("weight", each).select("weight", F.col("candidate").alias("candidate_id"), "parent", (F.col("weight") * F.col("v") + (1 - F.col("weight")) * F.col("a")).alias("score"))
    order = W.partitionBy("weight", "candidate_id").orderBy(F.desc("score"), "parent")
    top = scored.withColumns({"margin": F.col("score") - F.lead("score").over(order), "_n": F.row_number().over(order)}).where("_n = 1").drop("_n").withColumnRenamed("parent", "top_parent")
    out = labels.drop("score", "margin", "top_parent", "status", "method").withColumn("weight", each).join(top, ["weight", "candidate_id"], "left")
    return out.withColumns({"method": F.lit("F-fusion"), "status": F.when(F.col("score").isNull(), "not_evaluated").otherwise("evaluated")})


def held_out_fusion(rows: DataFrame, duration: int) -> DataFrame:
    """Leave one identity out: for each weight of :func:`fused_rows`, a threshold is fitted without each identity and
    counted on it. One row a weight: what was held out, the fit on all rows (threshold, tpr, fpr; null without one), and
    whether it is qualified: it has a fit on all rows, and passes the gates on what was held out.

    The curve without an identity is the whole curve less the identity's own counts, so rows are never repeated: curve
    points, one a distinct score, meet identities, of which a calibration set has few by design."""
    gate = GATES["F"]
    judged = _judged(rows.withColumn("minimum_duration_s", F.lit(duration)))
    best = lambda *by: W.partitionBy(*by).orderBy(F.desc("tpr"), "fpr", F.desc("threshold"))
    passing = (F.col("tpr") >= gate[0]) & (F.col("fpr") <= gate[1]) & (F.col("available") == F.col("expected"))
    whole = operating_curve(rows.withColumn("minimum_duration_s", F.lit(duration)), ["weight"]).withColumns({"available": F.col("negative_available_denominator"), "expected": F.col("negative_expected_denominator")})
    full = whole.where(passing).withColumn("_n", F.row_number().over(best("weight"))).where("_n = 1").select("weight", F.col("threshold").alias("full_threshold"), F.col("tpr").alias("full_tpr"), F.col("fpr").alias("full_fpr"))

    ids = _denominators(judged, ["weight", "identity"]).toDF("weight", "identity", "own_positive", "own_available", "own_expected")
    own = judged.where("x IS NOT NULL").groupBy("weight", "identity", F.col("x").alias("threshold")).agg(F.count("*").alias("own_here"), *[F.count_if(c).alias(f"own_{c}") for c in ("tp", "fp")])
    here = judged.where("x IS NOT NULL").groupBy("weight", F.col("x").alias("threshold")).agg(F.count("*").alias("here"))
    points = whole.join(here, ["weight", "threshold"], "left").join(ids, "weight").join(own, ["weight", "identity", "threshold"], "left")
    above = W.partitionBy("weight", "identity").orderBy(F.desc("threshold")).rangeBetween(W.unboundedPreceding, 0)
    less = lambda total, c: F.col(total) - F.coalesce(F.sum(c).over(above), F.lit(0))
    left = points.withColumns({"tp_": less("tp_correct_parent", "own_tp"), "fp_": less("fp", "own_fp")})
    # A score that the identity alone has is no threshold without it.
    left = left.where("here IS NULL OR here > coalesce(own_here, 0)")
    left = left.withColumns({"tpr": rate(F.col("tp_"), F.col("positive_denominator") - F.col("own_positive")), "fpr": rate(F.col("fp_"), F.col("available") - F.col("own_available")), "available": F.col("available") - F.col("own_available"), "expected": F.col("expected") - F.col("own_expected")})
    fitted = left.where(passing).withColumn("_n", F.row_number().over(best("weight", "identity"))).where("_n = 1").select("weight", "identity", F.col("threshold").alias("fitted"))

    tested = judged.join(fitted, ["weight", "identity"], "left").withColumn("supported", F.coalesce(F.col("x") >= F.col("fitted"), F.lit(False)))
    out = tested.groupBy("weight").agg(
        F.count_if(F.col("supported") & F.col("tp")).alias("held_out_tp"),
        F.count_if("truth").alias("held_out_positive"),
        F.count_if(F.col("supported") & F.col("fp")).alias("held_out_fp"),
        F.count_if(~F.col("truth")).alias("held_out_negative"),
    )
    ok = (rate(F.col("held_out_tp"), F.col("held_out_positive")) >= gate[0]) & (rate(F.col("held_out_fp"), F.col("held_out_negative")) <= gate[1])
    return out.join(full, "weight", "left").withColumn("qualified", F.coalesce(F.col("full_threshold").isNotNull() & ok, F.lit(False)))


def chosen_fusion(trials: DataFrame) -> DataFrame:
    """The qualified trial of greatest held-out true-positive rate, then least false-positive rate, then least weight; no
    row if none is qualified. A handful of rows."""
    order = W.orderBy(F.desc(F.col("held_out_tp") / F.col("held_out_positive")), F.col("held_out_fp") / F.col("held_out_negative"), "weight")
    return trials.where("qualified").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


__all__ = ["candidate_thresholds", "chosen_fusion", "chosen_method", "distributions", "fused_rows", "fusion_constituents", "held_out_fusion", "nearest_rank", "operating_curve", "operating_points", "overlap_hints", "running_sums", "select_threshold", "threshold_curve", "threshold_profile"]
