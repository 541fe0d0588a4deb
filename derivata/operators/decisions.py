"""Decisions, fusion and routing over scored rows (candidate_id, method, score, margin, top_parent, status, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import chained

AMBIGUITY_MARGIN = 0.05


def truth_of(method: Column) -> Column:
    """Which ancestry a method is judged by."""
    return chained([(method == "F-fusion", F.col("visual_ancestry") | F.col("audio_ancestry")), (method.startswith("V-"), F.col("visual_ancestry"))], F.col("audio_ancestry"))


def decision(threshold: Column, minimum: Column, least: float = AMBIGUITY_MARGIN) -> Column:
    """struct<state, parent, processing_state, reason> by priority: evidence, operating point, duration and score,
    margin. A missing margin never makes a row ambiguous."""
    none = F.lit(None).cast("string")
    out = lambda state, reason, parent=none, processing=F.lit("evaluated"): F.struct(F.lit(state).alias("state"), parent.cast("string").alias("parent"), processing.alias("processing_state"), F.lit(reason).alias("reason"))
    seconds = F.coalesce("observed_duration_s", "length_s")
    return chained(
        [
            ((F.col("row_status") != "evaluated") | (F.col("status") != "evaluated") | F.col("score").isNull(), out("insufficient", "unavailable_evidence", processing=F.col("status"))),
            (threshold.isNull(), out("insufficient", "no_qualified_operating_point")),
            ((seconds < minimum) | (F.col("score") < threshold), out("insufficient", "duration_or_score")),
            (F.coalesce(F.col("margin") < least, F.lit(False)), out("AMBIGUOUS", "competing_registered_parents")),
        ],
        out("supported", "qualified_score_and_margin", F.col("top_parent")),
    )


def fuse(visual: Column, audio: Column, mode: str, visual_threshold: float = 0.5, audio_threshold: float = 0.5) -> Column:
    """struct<status, supported, score> of two scores, either of which may be missing."""
    v, a = F.coalesce(visual >= visual_threshold, F.lit(False)), F.coalesce(audio >= audio_threshold, F.lit(False))
    both = visual.isNotNull() & audio.isNotNull()
    mean = F.lit(0.5) * visual + F.lit(0.5) * audio
    modes = {
        "visual_only": (v, visual),
        "audio_only": (a, audio),
        "visual_or_audio": (v | a, F.greatest(visual, audio)),
        "visual_and_audio": (v & a, F.when(both, F.least(visual, audio))),
        "calibrated": (F.when(both, mean >= 0.5).otherwise(v | a), F.when(both, mean).otherwise(F.coalesce(visual, audio))),
    }
    supported, score = modes.get(mode, (F.lit(False), F.lit(None).cast("double")))
    return F.struct(F.when(score.isNull(), "not_evaluated").otherwise("ok").alias("status"), supported.alias("supported"), score.cast("double").alias("score"))


def fused_pairs(visual: DataFrame, audio: DataFrame, weight: float) -> DataFrame:
    """(candidate, parent, score, rank, margin) over parents that both methods verified; weight is the visual one's."""
    pairs = visual.select("candidate", "parent", F.col("score").alias("v")).join(audio.select("candidate", "parent", F.col("score").alias("a")), ["candidate", "parent"]).where("v IS NOT NULL AND a IS NOT NULL")
    order = W.partitionBy("candidate").orderBy(F.desc("score"), "parent")
    scored = pairs.select("candidate", "parent", (F.lit(weight) * F.col("v") + F.lit(1 - weight) * F.col("a")).alias("score"))
    return scored.withColumns({"rank": F.row_number().over(order), "margin": F.col("score") - F.lead("score").over(order)})


def route(v: Column, a: Column) -> list[Column]:
    """Columns of routing from two decisions: conflict, disagreement, OR and AND states with their parents."""
    vs, as_ = v["state"] == "supported", a["state"] == "supported"
    conflict = vs & as_ & ~v["parent"].eqNullSafe(a["parent"])
    either = chained([(conflict, F.lit("AMBIGUOUS")), (vs | as_, F.lit("supported")), ((v["state"] == "AMBIGUOUS") | (a["state"] == "AMBIGUOUS"), F.lit("AMBIGUOUS"))], F.lit("insufficient"))
    both = chained([(conflict, F.lit("AMBIGUOUS")), (vs & as_, F.lit("supported"))], F.lit("insufficient"))
    return [
        v["state"].alias("visual_only"),
        a["state"].alias("audio_only"),
        either.alias("visual_or_audio"),
        both.alias("visual_and_audio"),
        (conflict | (vs != as_)).alias("disagreement"),
        F.when(conflict, None).when(vs, v["parent"]).when(as_, a["parent"]).alias("or_parent"),
        F.when(both == "supported", v["parent"]).alias("and_parent"),
    ]


def matchability_visual(change: Column, edge: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.6) * change / 40 + F.lit(0.4) * edge / 40)


def matchability_audio(deviation: Column) -> Column:
    return F.least(F.lit(1.0), 5 * deviation)
