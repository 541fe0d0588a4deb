"""The candidate design: sources and negatives by lengths and transforms, with their true intervals; all relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import chained
from ..functions.canonical import padded_id
from ..functions.ordinals import numbered

# Fixed values of the design.
LENGTHS = (1, 2, 3, 5, 10, 15, 30)
ANCHORS = ("trim", "h264_q35", "crop25", "speed125", "audio_replace", "subtitles")
ROTATING = (
    "h264_q18", "h264_q42", "mpeg4", "scale720", "scale480", "scale360", "crop10", "crop40",
    "crop60", "offcenter25", "mirror", "rotate5", "rotate15", "perspective", "letterbox", "speed075",
    "speed150", "reordered", "discontinuous", "frame_insert_delete", "logo", "central_text", "picture_in_picture", "reaction_layout",
    "audio_offset", "pitch_up2", "music_overlay", "noise_compression", "silence_insertion", "screen_recording", "film_monitor", "upscale_lanczos",
    "frame_interpolation", "denoise",
)
HARSH = ("crop60", "h264_q42", "reordered", "discontinuous", "central_text", "reaction_layout")
OVERLAYS = ("subtitles", "logo", "central_text", "picture_in_picture", "reaction_layout")
LIGHT = ("upscale_lanczos", "frame_interpolation", "denoise")


#: Negatives that share content with sources, so that evidence may be ambiguous by design.
SHARED = ("N18", "N21", "N24")


def family(name: Column) -> Column:
    starts = lambda *p: name.rlike("^(" + "|".join(p) + ")")
    return chained(
        [
            (starts("audio", "pitch", "music", "noise", "silence"), F.lit("AUDIO")),
            (starts("speed", "reordered", "discontinuous", "frame_", "trim") & (name != "frame_interpolation"), F.lit("TEMPORAL")),
            (name.isin(*OVERLAYS), F.lit("OVERLAY")),
            (name.isin("screen_recording", "film_monitor"), F.lit("CAPTURE")),
            (name.isin(*LIGHT), F.lit("AI_LIGHT")),
            (starts("h264", "mpeg4", "scale"), F.lit("TRANSCODING")),
        ],
        F.lit("GEOMETRY"),
    )


def severity(name: Column) -> Column:
    return F.when(name.isin(*HARSH), "harsh").otherwise("moderate")


def speed(name: Column) -> Column:
    return F.when(name == "speed075", 0.75).when(name == "speed125", 1.25).when(name == "speed150", 1.5).otherwise(1.0)


def true_intervals(name: Column, length: Column) -> Column:
    """Source intervals of a derivative: one from 2 s on, scaled by speed; two for cut and reordered ones."""
    half = length / F.lit(2.0)
    pair = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    two = F.lit(2.0)
    return (
        F.when(name == "discontinuous", F.array(pair(two, two + half), pair(F.lit(26.0), F.lit(26.0) + half)))
        .when(name == "reordered", F.array(pair(F.lit(4.0) + half, F.lit(4.0) + length), pair(two, two + half)))
        .otherwise(F.array(pair(two, two + length * speed(name))))
    )


def frame_mapping(intervals: Column, length: Column) -> Column:
    """Which part of a candidate comes from which source interval: equal parts, in their order."""
    n = F.size(intervals)
    part = lambda i: F.struct((i * length / n).cast("double").alias("a"), ((i + 1) * length / n).cast("double").alias("b"))
    return F.transform(intervals, lambda x, i: F.struct(part(i).alias("candidate"), x.alias("source")))


def zipped_intervals(source: Column, candidate: Column) -> Column:
    """Source and candidate intervals by their place, as mapped pairs. Both keep the order they are given in; the shorter
    list decides how many."""
    pairs = F.filter(F.arrays_zip(source.alias("source"), candidate.alias("candidate")), lambda x: x["source"].isNotNull() & x["candidate"].isNotNull())
    return F.transform(pairs, lambda x: F.struct(x["source"].alias("source"), x["candidate"].alias("candidate")))


def first_candidates(sources: DataFrame, chains: DataFrame, lengths: tuple[float, ...]) -> DataFrame:
    """The first experiment's candidates with their truth in milliseconds, from sources (source_id, duration_s) and chains
    (chain_no, transforms, speed, two_fragments, reordered, audio_replaced): numbered by source, length and chain.

    A length needs half a second to spare, and cut or reordered chains five seconds. Most start within the first second;
    cut ones at .5 s and 8 s, reordered ones at 1 s, after the later half."""
    rows = sources.withColumn("length", F.explode(F.array(*[F.lit(float(x)) for x in lengths]))).where(F.col("length") <= F.col("duration_s") - 0.5)
    special = F.col("two_fragments") | F.col("reordered")
    both = rows.crossJoin(chains).where(~special | (F.col("length") >= 5))  # chains are a handful
    start = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("duration_s") - F.col("length")) / 4))
    half, ms = F.col("length") / 2, lambda x: F.floor(x * 1000).cast("bigint")
    pair = lambda a, b: F.struct(ms(a).alias("start_ms"), ms(b).alias("end_ms"))
    one, zero = F.lit(1.0), F.lit(0.0)
    truth = F.when(F.col("two_fragments"), F.array(pair(F.lit(0.5), 0.5 + half), pair(F.lit(8.0), 8.0 + half))).when(F.col("reordered"), F.array(pair(one + half + 1, one + half + 1 + half), pair(one, one + half))).otherwise(F.array(pair(start, start + F.col("length") * F.col("speed"))))
    own = F.when(special, F.array(F.struct(F.lit(0).cast("bigint").alias("start_ms"), ms(half).alias("end_ms")), pair(half, F.col("length")))).otherwise(F.array(pair(zero, F.col("length"))))
    made = both.withColumns({"source_intervals_ms": truth, "candidate_intervals_ms": own, "visual_ancestry": F.lit(True), "audio_ancestry": ~F.col("audio_replaced")})
    kept = made.select("source_id", "length", "chain_no", "transforms", "source_intervals_ms", "candidate_intervals_ms", "visual_ancestry", "audio_ancestry")
    return numbered(kept, "source_id", "length", "chain_no").withColumn("candidate_id", padded_id("C", F.col("number"), 4)).drop("number")


def generated_sequences(spark: SparkSession, n: int, frames: int, seed: int) -> DataFrame:
    """(id, hashes): reproducible hash sequences for tests and trials, by digests of seed, id and frame."""
    place = lambda i: F.xxhash64(F.lit(seed), F.col("id"), i)
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), place).alias("hashes"))


def design(spark: SparkSession, n_sources: int = 16, n_negatives: int = 24) -> DataFrame:
    """One row a candidate, numbered in the order of sources, negatives, lengths and transforms."""
    lengths = F.posexplode(F.array(*map(F.lit, LENGTHS)))
    sources = spark.range(1, n_sources + 1).select(padded_id("S", F.col("id"), 2).alias("identity"), F.col("id").alias("number"), F.lit("source").alias("role"))
    negatives = spark.range(1, n_negatives + 1).select(padded_id("N", F.col("id"), 2).alias("identity"), F.col("id").alias("number"), F.lit("negative").alias("role"))
    rotating = F.array(*map(F.lit, ROTATING))
    turn = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.element_at(rotating, ((F.col("number") * 7 + F.col("li") * 6 + j) % len(ROTATING) + 1).cast("int")))
    names = F.when(F.col("role") == "source", F.concat(F.array(*map(F.lit, ANCHORS)), turn)).otherwise(F.array(F.lit("negative_excerpt")))
    rows = sources.union(negatives).select("*", lengths.alias("li", "length_s")).select("*", F.posexplode(names).alias("ti", "transform"))
    per = len(ANCHORS) + 6
    before = F.when(F.col("role") == "source", ((F.col("number") - 1) * len(LENGTHS) + F.col("li")) * per).otherwise(F.lit(n_sources * len(LENGTHS) * per) + (F.col("number") - 1) * len(LENGTHS) + F.col("li"))
    t, length, source = F.col("transform"), F.col("length_s"), F.col("role") == "source"
    return rows.select(
        padded_id("E", before + F.col("ti") + 1, 5).alias("candidate_id"),
        "identity",
        "role",
        "length_s",
        "transform",
        family(t).alias("family"),
        severity(t).alias("severity"),
        speed(t).alias("speed"),
        F.when(source, true_intervals(t, length)).otherwise(F.array().cast("array<struct<a:double,b:double>>")).alias("source_intervals"),
        source.alias("visual_ancestry"),
        (source & (t != "audio_replace") & ~((t == "audio_offset") & (length <= 1.5))).alias("audio_ancestry"),
        F.when(source, F.col("identity")).alias("expected_parent"),
        F.when(source, frame_mapping(true_intervals(t, length), length)).otherwise(F.array().cast("array<struct<candidate:struct<a:double,b:double>,source:struct<a:double,b:double>>>")).alias("frame_mapping"),
        F.col("identity").isin(*SHARED).alias("expected_ambiguity"),
    )
