"""Accounting: confusion counts with three-valued availability, summaries, breakdowns, comparisons and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions.bits import chained
from ..functions.statistics import f1, rate

MODES = ("visual_only", "audio_only", "visual_or_audio", "visual_and_audio")
GATE = {"iou": 0.7, "start": 1.0, "end": 1.0, "false_continuous": 0.05, "coverage": 0.7}


def confusion(truth: Column, claimed: Column) -> list[Column]:
    return [F.count_if(truth & claimed).alias("tp"), F.count_if(~truth & claimed).alias("fp"), F.count_if(~truth & ~claimed).alias("tn"), F.count_if(truth & ~claimed).alias("fn")]


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds tpr, fpr, precision, recall, f1; null where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    return counts.withColumns({"tpr": recall, "fpr": rate(fp, fp + tn), "precision": precision, "recall": recall, "f1": f1(precision, recall), "n_positive": tp + fn, "n_negative": fp + tn})


def summary(decided: DataFrame, by: list[str]) -> DataFrame:
    """One wide row a group from rows with truth, decision (struct), expected_parent, margin and identity.

    Rates count evaluated rows only; the lower bound of tpr counts all expected positives. Missing is not zero."""
    truth, d = F.col("truth"), F.col("decision")
    ready, yes = d["processing_state"] == "evaluated", d["state"] == "supported"
    right = d["parent"].eqNullSafe(F.col("expected_parent"))
    n = lambda c, name: F.count_if(c).alias(name)
    out = decided.groupBy(*by).agg(
        F.count("*").alias("n_expected"),
        n(truth, "positive_expected"),
        n(~truth, "negative_expected"),
        n(ready, "n_evaluated"),
        n(d["state"] == "AMBIGUOUS", "ambiguous"),
        n(truth & yes & right, "correct_parent"),
        n(truth & yes & ~right, "wrong_parent"),
        n(truth & (d["state"] == "AMBIGUOUS"), "ambiguous_parent"),
        n(truth & ~ready, "unavailable_positive"),
        n(~truth & ~ready, "unavailable_negative"),
        n(truth & ready & yes, "tp"),
        n(~truth & ready & yes, "fp"),
        n(~truth & ready & ~yes, "tn"),
        n(truth & ready & ~yes, "fn"),
        F.avg("margin").alias("mean_margin"),
    )
    return with_rates(out).withColumn("tpr_lower_bound", rate(F.col("tp"), F.col("positive_expected")))


def with_recall(decided: DataFrame, top: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(by, n_derivatives, recall_at_k...): true parents among the first k of the recorded ranking (by, candidate_id,
    parent, rank) only; a derivative without a ranking counts as not found."""
    wanted = decided.where("truth").select(*by, "candidate_id", F.col("expected_parent").alias("parent"))
    best = wanted.join(top.select(*by, "candidate_id", "parent", "rank"), [*by, "candidate_id", "parent"], "left").groupBy(*by, "candidate_id").agg(F.min("rank").alias("rank"))
    return best.groupBy(*by).agg(F.count("*").alias("n_derivatives"), *[rate(F.count_if(F.col("rank") <= k), F.count("*")).alias(f"recall_at_{k}") for k in ks])


def identity_false_positives(decided: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_identities, n_with_fp): identities of evaluated negatives, and those with any supported one."""
    negative = decided.where(~F.col("truth") & (F.col("decision.processing_state") == "evaluated"))
    each = negative.groupBy(*by, "identity").agg(F.bool_or(F.col("decision.state") == "supported").alias("any_fp"))
    return each.groupBy(*by).agg(F.count("*").alias("n_identities"), F.count_if("any_fp").alias("n_with_fp"))


def breakdown(decided: DataFrame, dimensions: list[str], fixed: list[str]) -> DataFrame:
    """The summary's counts in all, and by each dimension alone, in one pass of grouping sets."""
    truth, d = F.col("truth"), F.col("decision")
    ready, yes = d["processing_state"] == "evaluated", d["state"] == "supported"
    sets = [fixed, *[[*fixed, x] for x in dimensions]]
    grouped = decided.groupingSets([[F.col(c) for c in s] for s in sets], *fixed, *dimensions)
    level = F.coalesce(*[F.when(F.grouping(x) == 0, F.lit(x)) for x in dimensions], F.lit("total"))
    value = F.coalesce(*[F.when(F.grouping(x) == 0, F.coalesce(F.col(x).cast("string"), F.lit(""))) for x in dimensions], F.lit(""))
    return grouped.agg(level.alias("dimension"), value.alias("value"), F.count("*").alias("n"), *[c for c in confusion_ready(truth, ready, yes)]).select(*fixed, "dimension", "value", "n", "tp", "fp", "tn", "fn")


def confusion_ready(truth: Column, ready: Column, yes: Column) -> list[Column]:
    return [F.count_if(truth & ready & yes).alias("tp"), F.count_if(~truth & ready & yes).alias("fp"), F.count_if(~truth & ready & ~yes).alias("tn"), F.count_if(truth & ready & ~yes).alias("fn")]


def multimodal(routed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion of each routing mode against the truth of that mode, in each group."""
    by = by or []
    v, a = F.col("visual_ancestry"), F.col("audio_ancestry")
    truths = {"visual_only": v, "audio_only": a, "visual_or_audio": v | a, "visual_and_audio": v & a}
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), truths[m].alias("truth"), (F.col(m) == "supported").alias("yes")) for m in MODES])
    return with_rates(routed.select(*by, F.inline(modes)).groupBy(*by, "mode").agg(*confusion(F.col("truth"), F.col("yes"))))


def temporal_rows(claims: DataFrame) -> DataFrame:
    """``claims`` (claimed, truth intervals, right_parent, n_claimed, n_truth) with iou, start_error, end_error and
    false_continuous. A wrong parent or no claim has IoU 0 and no errors."""
    valid = F.col("right_parent") & (F.size("claimed") > 0)
    c, t = F.col("claimed"), F.col("truth")
    return claims.withColumns(
        {
            "iou": F.when(valid, iv.iou(c, t)).otherwise(F.lit(0.0)),
            "start_error": F.when(valid, iv.start_error(c, t)),
            "end_error": F.when(valid, iv.end_error(c, t)),
            "padding": F.when(valid, iv.padding_inflation(c, t)),
            "false_continuous": F.when(F.col("n_truth") > 1, valid & (F.col("n_claimed") <= 1)),
            "aligned": valid,
        }
    )


def temporal_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    several = F.col("false_continuous").isNotNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("iou").alias("mean_iou"),
        F.avg("start_error").alias("mean_start_error"),
        F.avg("end_error").alias("mean_end_error"),
        F.count_if(several).alias("n_several"),
        F.count_if(several & F.col("false_continuous")).alias("n_false_continuous"),
        rate(F.count_if(F.col("aligned")), F.count("*")).alias("coverage"),
    )


def alignment_verdict(summaries: DataFrame) -> DataFrame:
    """``summaries`` (one row a method: all_ and issued_ measures of :func:`temporal_verdict_input`) with verdict.

    IoU and coverage are those of all rows, boundary errors and false-continuous rate those of issued claims. A missing
    measure is never good; above .2 of false-continuous claims it is NO-GO."""
    share = rate(F.col("issued_n_false_continuous"), F.col("issued_n_several"))
    good = (F.col("all_mean_iou") >= GATE["iou"]) & (F.col("issued_mean_start_error") <= GATE["start"]) & (F.col("issued_mean_end_error") <= GATE["end"]) & (share <= GATE["false_continuous"]) & (F.col("all_coverage") >= GATE["coverage"])
    return summaries.withColumn("verdict", chained([(F.coalesce(share > 0.2, F.lit(False)), F.lit("NO-GO")), (F.coalesce(good, F.lit(False)), F.lit("GO"))], F.lit("CAUTION")))


def temporal_verdict_input(rows: DataFrame, by: list[str], issued: Column) -> DataFrame:
    """One row a group with the temporal summary of all rows (all_...) and of those with an issued claim (issued_...)."""
    named = lambda df, p: df.select(*by, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by])
    return named(temporal_summary(rows, by), "all").join(named(temporal_summary(rows.where(issued), by), "issued"), by, "left")


def modality_verdict(summaries: DataFrame, gates: dict[str, tuple[float, float]], methods: tuple[str, ...] = ("V-B", "V-C", "A-chromaprint"), by: list[str] | None = None) -> DataFrame:
    """(by, modality, verdict, n_passed) from one row a method (method, has_point, correct_parent_rate, fpr): GO if one of the
    methods that a verdict may rest on has an operating point and passes its gates, on the qualification subset. Baselines
    and others don't count."""
    kind = F.substring("method", 1, 1)
    gate = lambda i: F.coalesce(*[F.when(kind == k, F.lit(g[i])) for k, g in gates.items()])
    ok = F.coalesce(F.col("method").isin(*methods) & F.col("has_point") & (F.col("correct_parent_rate") >= gate(0)) & (F.col("fpr") <= gate(1)), F.lit(False))
    out = summaries.groupBy(*(by or []), F.when(kind == "V", "visual").otherwise("audio").alias("modality")).agg(F.count_if(ok).alias("n_passed"))
    return out.select(*(by or []), "modality", F.when(F.col("n_passed") > 0, "GO").otherwise("NO-GO").alias("verdict"), "n_passed")


def overall_verdict(visual: Column, audio: Column, alignment: Column, either_tpr: Column, single_tpr: Column, either_fpr: Column) -> Column:
    """One of STRONG GO, CORE GO, CAUTION and CORE NO-GO.

    NO-GO if neither modality passes or alignment is NO-GO; CORE GO needs good alignment and one modality; STRONG GO
    both, and that either of them supports more than the better one alone (tpr of OR against that of the best single
    mode) at a false-positive rate of .02 or less. Reproducibility has a verdict of its own and takes no part."""
    none = ((visual != "GO") & (audio != "GO")) | (alignment == "NO-GO")
    core = (alignment == "GO") & ((visual == "GO") | (audio == "GO"))
    zero = F.lit(0.0)
    strong = (visual == "GO") & (audio == "GO") & (F.coalesce(either_tpr, zero) > F.coalesce(single_tpr, zero)) & (F.coalesce(either_fpr, zero) <= 0.02)
    return chained([(none, F.lit("CORE NO-GO")), (core & strong, F.lit("STRONG GO")), (core, F.lit("CORE GO"))], F.lit("CAUTION"))


def resource_sums(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, wall_s_sum, rss_max, bytes_sum) of runs (by, wall_s, rss_bytes, size_bytes); missing ones count as 0."""
    some = lambda c: F.coalesce(c, F.lit(0))
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.sum(some("wall_s")).alias("wall_s_sum"), F.max(some("rss_bytes")).alias("rss_max"), F.sum(some("size_bytes")).alias("bytes_sum"))


def score_export(decided: DataFrame) -> DataFrame:
    """(method, partition, candidate_id, identity, score, positive, status, length_s, transform): what is needed to draw
    score distributions again, as rows."""
    return decided.select("method", "partition", "candidate_id", "identity", "score", F.col("truth").alias("positive"), "status", "length_s", "transform")


def first_evaluation(rows: DataFrame, visual_threshold: Column, audio_threshold: Column) -> DataFrame:
    """One row of the first experiment's evaluation from rows (row_status, disposition, partition, is_derivative,
    visual_ancestry, audio_ancestry, visual_score, audio_score, top_parent, true_parent).

    Classification is over scored rows of the evaluation partition, and null without any; failures and ambiguity count
    over all partitions, as their names say. Recall at 1 is that of derivatives' top parent."""
    ready = F.col("row_status") == "ok"
    here = ready & (F.col("partition") == "evaluation")
    measures = []
    for name, threshold in (("visual", visual_threshold), ("audio", audio_threshold)):
        scored = here & F.col(f"{name}_score").isNotNull() & threshold.isNotNull()
        truth, yes = F.col("is_derivative") & F.col(f"{name}_ancestry"), F.col(f"{name}_score") >= threshold
        n = lambda c, scored=scored: F.count_if(F.coalesce(scored & c, F.lit(False)))
        tp, fp, tn, fn = n(truth & yes), n(~truth & yes), n(~truth & ~yes), n(truth & ~yes)
        precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
        measures += [c.alias(f"{name}_{k}") for k, c in {"n": tp + fp + tn + fn, "tp": tp, "fp": fp, "tn": tn, "fn": fn, "tpr": recall, "fpr": rate(fp, fp + tn), "precision": precision, "f1": f1(precision, recall)}.items()]
    derivative = here & F.col("is_derivative")
    found = derivative & F.col("top_parent").eqNullSafe(F.col("true_parent"))
    return rows.agg(
        *measures,
        F.count_if(~ready).alias("n_failed_all_partitions"),
        F.count_if(ready & F.coalesce(F.col("disposition") == "AMBIGUOUS", F.lit(False))).alias("n_ambiguous_all_partitions"),
        F.count_if(derivative).alias("n_derivative"),
        rate(F.count_if(found), F.count_if(derivative)).alias("recall_at_1"),
    )


def harness_verdict(n_temporal: Column, false_continuous_rate: Column, n_calibration_positive: Column, reproducibility: Column) -> Column:
    """PASS, CAUTION or NO-GO of the first experiment: unstable results stop it; few positives to calibrate with, or no
    temporal rows at all, are a caution."""
    cautious = (false_continuous_rate.isNull() & (n_temporal == 0)) | (F.coalesce(n_calibration_positive, F.lit(0)) < 3)
    return chained([(F.coalesce(reproducibility == "UNSTABLE", F.lit(False)), F.lit("NO-GO")), (cautious, F.lit("CAUTION"))], F.lit("PASS"))


def resource_check(n_candidates: int, seconds_each: float, mean_bytes: float, free_disk_bytes: int) -> dict:
    """Whether a design fits the declared bounds, from what one candidate took before: five times its matching time and
    two hours of generation, twelve times its bytes, and so much disk left free. Refuses a design that does not."""
    estimate = {"cpu_hours": n_candidates * seconds_each * 5 / 3600 + 2, "storage_bytes": max(8_000_000_000, n_candidates * mean_bytes * 12)}
    bound = {"cpu_hours": 18, "storage_bytes": min(16_000_000_000, free_disk_bytes - 10_000_000_000)}
    if any(estimate[k] >= bound[k] for k in bound):
        raise ValueError(f"the design exceeds its bounds: {estimate} against {bound}")
    return {"estimate": estimate, "bound": bound, "decision": "proceed"}


def compare_runs(first: DataFrame, second: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """One row that compares two runs (key, status, digest, score): matches, one-sided keys, greatest difference, and
    the class that follows from them."""
    a = first.select(key, F.col("status").alias("s1"), F.col("digest").alias("d1"), F.col("score").alias("x1"), F.lit(True).alias("in1"))
    b = second.select(key, F.col("status").alias("s2"), F.col("digest").alias("d2"), F.col("score").alias("x2"), F.lit(True).alias("in2"))
    both = a.join(b, key, "full_outer")
    shared = F.col("in1").isNotNull() & F.col("in2").isNotNull()
    difference = F.abs(F.col("x1") - F.col("x2"))
    out = both.agg(
        F.count_if(shared).alias("n_shared"),
        F.count_if(F.col("in2").isNull()).alias("only_first"),
        F.count_if(F.col("in1").isNull()).alias("only_second"),
        F.count_if(shared & F.col("s1").eqNullSafe(F.col("s2"))).alias("same_status"),
        F.count_if(shared & F.col("d1").eqNullSafe(F.col("d2"))).alias("same_digest"),
        F.count_if(shared & F.col("x1").eqNullSafe(F.col("x2"))).alias("same_score"),
        F.count_if(shared & (F.col("x1").eqNullSafe(F.col("x2")) | (difference <= tolerance))).alias("near_score"),
        F.max(F.when(shared, difference)).alias("max_difference"),
    )
    whole = (F.col("only_first") + F.col("only_second") == 0) & (F.col("same_status") == F.col("n_shared"))
    kind = chained([(whole & (F.col("same_digest") == F.col("n_shared")) & (F.col("same_score") == F.col("n_shared")), F.lit("BIT_DETERMINISTIC")), (whole & (F.col("near_score") == F.col("n_shared")), F.lit("TOLERANCE_REPRODUCIBLE"))], F.lit("UNSTABLE"))
    return out.withColumn("reproducibility", kind)


def worst_class(classes: Column) -> Column:
    """The worst of an array of reproducibility classes."""
    order = ["BIT_DETERMINISTIC", "TOLERANCE_REPRODUCIBLE", "UNSTABLE"]
    return F.element_at(F.array(*map(F.lit, order)), F.array_max(F.transform(classes, lambda x: F.array_position(F.array(*map(F.lit, order)), x))).cast("int"))


def by_status(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "status").agg(F.count("*").alias("n"))


def false_positive_concentration(decided: DataFrame) -> DataFrame:
    """(identity, parent, n): which parents are wrongly claimed of which negatives."""
    return decided.where(~F.col("truth") & (F.col("decision.state") == "supported")).groupBy("identity", F.col("decision.parent").alias("parent")).agg(F.count("*").alias("n"))
