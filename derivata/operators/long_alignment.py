"""Placing short sequences of frame hashes in sources of any length, exactly.

A source is rows of overlapping chunks, so no row holds a whole one. For every pair of a candidate and a source, the sum
of Hamming distances over the candidate's n frames is least at some offset; of equal ones the first counts.

Seeds find most of them. Frames of candidates and sources within ``RADIUS`` bits meet by an equi-join over bands of
their bits, and each gives an offset. At an offset without a seed, all of the candidate's u seeding frames are off by
more than the radius, so its sum is (RADIUS + 1) u or more. A pair whose best seeded sum is below that is settled, and
only its seeded offsets were looked at. All other pairs are scanned, chunk by chunk. Frames whose bands are too common to
tell places apart (black ones, say) don't seed, which only lowers u: no seed is dropped without its bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..functions import intervals as iv
from ..functions.ordinals import checkpointed

#: Frames of a chunk, bits within which frames seed, and the bands that are compared.
CHUNK, RADIUS, BANDS = 4096, 3, 4
#: Source frames that may share a band before it seeds no more.
COMMON = 10_000


def chunked(frames: DataFrame, overlap: int, size: int = CHUNK) -> DataFrame:
    """(src, chunk, first, frames binary) of source frames (src, pos from 0 on, hash): ``size`` frames and as many more of
    what follows as ``overlap`` says, so that a sequence of overlap + 1 frames that begins in a chunk lies in it."""
    own = F.floor(F.col("pos") / size).cast("bigint")
    before = F.greatest(F.floor((F.col("pos") - overlap) / size).cast("bigint"), F.lit(0).cast("bigint"))
    dealt = frames.select("src", "pos", "hash", F.explode(F.sequence(before, own)).alias("chunk"))
    packed = dealt.groupBy("src", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("x"))
    return packed.select("src", "chunk", (F.col("chunk") * size).alias("first"), F.transform("x", lambda x: x["hash"]).alias("frames"))


def _sums(candidate: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """The summed distance at every offset in a chunk."""
    n = max(len(frames) - len(candidate) + 1, 0)
    total = np.zeros(n, np.int64)
    for i, c in enumerate(candidate):
        total += np.bitwise_count((frames[i : i + n] ^ c).view(np.uint64))
    return total


def _placed(size: int):
    """(cand, src, total, offset) of the least sum in each row's chunk: at the offsets listed, or at all if there is none."""

    def run(batches):
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keep, totals, offsets = [], [], []
            for row in range(batch.num_rows):
                c, f = (column[name][row].values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for name in ("candidate", "frames"))
                first, listed = column["first"][row].as_py(), column["offsets"][row]
                if listed.is_valid:
                    at = np.sort(listed.values.to_numpy(zero_copy_only=False)) - first
                    at = at[(at >= 0) & (at < min(size, len(f) - len(c) + 1))]
                    sums = np.zeros(len(at), np.int64)
                    for i, x in enumerate(c):
                        sums += np.bitwise_count((f[at + i] ^ x).view(np.uint64))
                else:
                    sums = _sums(c, f)[:size]
                    at = np.arange(len(sums))
                if len(sums):
                    best = int(np.argmin(sums))  # the first of equal ones
                    keep.append(row)
                    totals.append(int(sums[best]))
                    offsets.append(first + int(at[best]))
            ids = [column[name].take(pa.array(keep, pa.int64())) for name in ("cand", "src")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(totals, pa.int64()), pa.array(offsets, pa.int64())], names=["cand", "src", "total", "offset"])

    return run


def _least(found: DataFrame) -> DataFrame:
    return found.groupBy("cand", "src").agg(F.min(F.struct("total", "offset")).alias("x")).select("cand", "src", "x.*")


def _bands(h: Column) -> Column:
    step = 64 // BANDS
    masks = [((1 << step) - 1) << (step * i) for i in range(BANDS)]
    return F.array(*[F.struct(F.lit(i).alias("band"), h.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("value")) for i, m in enumerate(masks)])


def seeds(candidates: DataFrame, frames: DataFrame, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """Offsets that seeds give (cand, src, offset), and the number of seeding frames u of each candidate (cand, u), from
    candidates (cand, candidate array) and source frames (src, pos, hash).

    A pair within ``RADIUS`` bits agrees in one of more bands than that. A candidate's frame seeds only if none of its
    bands is shared by more than ``common`` source frames, so what meets stays in proportion to the candidates."""
    if RADIUS >= BANDS:
        raise ValueError("needs more bands than differing bits")
    banded = frames.select("src", "pos", "hash", F.explode(_bands(F.col("hash"))).alias("b")).select("src", "pos", "hash", "b.*")
    crowded = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > common).select("band", "value")
    asked = candidates.select("cand", F.posexplode("candidate").alias("i", "h")).withColumn("b", F.explode(_bands(F.col("h")))).select("cand", "i", "h", "b.*")
    dull = asked.join(crowded, ["band", "value"]).select("cand", "i").distinct()
    sharp = asked.join(dull, ["cand", "i"], "left_anti")
    u = sharp.select("cand", "i").distinct().groupBy("cand").agg(F.count("*").alias("u"))
    met = sharp.join(banded, ["band", "value"]).where(F.bit_count(F.col("h").bitwiseXOR(F.col("hash"))) <= RADIUS)
    return met.select("cand", "src", (F.col("pos") - F.col("i")).alias("offset")).where("offset >= 0").distinct(), u


def placed(pairs: DataFrame, candidates: DataFrame, frames: DataFrame, longest: int, size: int = CHUNK, common: int = COMMON) -> DataFrame:
    """``pairs`` (cand, src) with n, total, offset and how (seeds or scan): the least summed distance of the candidate's
    frames over all offsets in the source, and the first offset that has it.

    candidates (cand, candidate array<bigint> of ``longest`` frames at most), frames (src, pos 0, 1, 2, ..., hash) without
    gaps. total and offset are null for a candidate without frames, or longer than the source."""
    too_long = F.raise_error(F.lit(f"a candidate has more than {longest} frames")).cast("array<bigint>")
    clips = candidates.where(F.size("candidate") > 0).select("cand", F.when(F.size("candidate") > longest, too_long).otherwise(F.col("candidate")).alias("candidate"))
    chunks = checkpointed(chunked(frames, longest - 1, size))
    offsets, u = seeds(clips, frames, common)
    asked = pairs.select("cand", "src").distinct()
    # Seeded offsets of a pair and chunk are one row; more than a chunk has they cannot be.
    listed = offsets.join(asked, ["cand", "src"], "left_semi").groupBy("cand", "src", F.floor(F.col("offset") / size).cast("bigint").alias("chunk")).agg(F.collect_list("offset").alias("offsets"))
    kind = ", ".join(f"{c} {t}" for c, t in [("cand", pairs.schema["cand"].dataType.simpleString()), ("src", pairs.schema["src"].dataType.simpleString())]) + ", total bigint, offset bigint"
    columns = ["cand", "src", "candidate", "first", "frames", "offsets"]
    seeded = _least(listed.join(chunks, ["src", "chunk"]).join(clips, "cand").select(*columns).mapInArrow(_placed(size), kind))
    judged = asked.join(seeded, ["cand", "src"], "left").join(u, "cand", "left")
    settled = F.coalesce(F.col("total") < (RADIUS + 1) * F.col("u"), F.lit(False))
    told = checkpointed(judged.withColumn("settled", settled))
    rest = told.where("NOT settled").select("cand", "src").join(clips, "cand").join(chunks, "src").withColumn("offsets", F.lit(None).cast("array<bigint>"))
    scanned = _least(rest.select(*columns).mapInArrow(_placed(size), kind)).withColumn("how", F.lit("scan"))
    out = told.where("settled").select("cand", "src", "total", "offset", F.lit("seeds").alias("how")).unionByName(scanned)
    sizes = candidates.select("cand", F.greatest(F.coalesce(F.size("candidate"), F.lit(0)), F.lit(0)).alias("n"))
    return asked.join(sizes, "cand", "left").join(out, ["cand", "src"], "left").select("cand", "src", "n", "total", "offset", "how")


def aligned(pairs: DataFrame, candidates: DataFrame, frames: DataFrame, longest: int, fps: float = 2.0, most: float = 16.0, size: int = CHUNK) -> DataFrame:
    """(cand, src, status, mean_distance, source_intervals, candidate_intervals, n_fragments) of each pair: the clip is
    placed as a whole and, if that is near enough, by halves; two places far apart make two fragments."""
    n, mid = F.size("candidate"), F.floor(F.size("candidate") / 2).cast("int")
    part = lambda name, x: F.struct(F.lit(name).alias("part"), x.alias("candidate"))
    cuts = candidates.withColumn("p", F.explode(F.array(part("whole", F.col("candidate")), part("lo", F.slice("candidate", F.lit(1), mid)), part("hi", F.slice("candidate", mid + 1, n - mid)))))
    named = cuts.select(F.struct("cand", "p.part").alias("cand"), F.col("p.candidate").alias("candidate"))
    asked = pairs.select(F.explode(F.array(*[F.struct("cand", F.lit(x).alias("part")) for x in ("whole", "lo", "hi")])).alias("cand"), "src")
    best = placed(asked, named, frames, longest, size).select("cand.cand", "cand.part", "src", "total", "offset")
    wide = best.groupBy("cand", "src").agg(*[F.first(F.when(F.col("part") == p, F.struct("total", "offset")), True).alias(p) for p in ("whole", "lo", "hi")])
    return _intervals(wide.join(candidates.select("cand", F.greatest(F.coalesce(F.size("candidate"), F.lit(0)), F.lit(0)).alias("n")), "cand"), fps, most)


def _intervals(rows: DataFrame, fps: float, most: float) -> DataFrame:
    n, mid, rate = F.col("n"), F.floor(F.col("n") / 2), F.lit(fps)
    mean = F.col("whole.total") / n
    close = (n >= 4) & (F.col("lo.total") <= most * mid) & (F.col("hi.total") <= most * (n - mid))
    lo, hi = F.col("lo.offset") / rate, F.col("hi.offset") / rate
    lo_end, hi_end = (F.col("lo.offset") + mid) / rate, (F.col("hi.offset") + n - mid) / rate
    apart = F.coalesce(close & ((F.abs(hi - lo) > n / rate * 1.3) | (F.abs(hi - lo_end) > 1.0)), F.lit(False))
    status = F.when(mean.isNull(), "not_evaluated").when(mean > most, "insufficient").otherwise("ok")
    span = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    start, end = F.col("whole.offset") / rate, (F.col("whole.offset") + n) / rate
    ok = status == "ok"
    return rows.select(
        "cand",
        "src",
        status.alias("status"),
        mean.alias("mean_distance"),
        F.when(ok, F.when(apart, F.array_sort(F.array(span(lo, lo_end), span(hi, hi_end)))).otherwise(F.array(span(start, end)))).otherwise(iv.empty()).alias("source_intervals"),
        F.when(ok, F.when(apart, F.array(span(F.lit(0.0), mid / rate), span(mid / rate, n / rate))).otherwise(F.array(span(F.lit(0.0), n / rate)))).otherwise(iv.empty()).alias("candidate_intervals"),
        F.when(ok, F.when(apart, 2).otherwise(1)).otherwise(0).alias("n_fragments"),
    )


def scores(best: DataFrame, width: int = 64) -> DataFrame:
    """Results of :func:`placed` with score: of 64-bit hashes, or of 32-bit fingerprints."""
    return best.withColumn("score", (bits.score64 if width == 64 else bits.score32)(F.col("total") / F.col("n")))
