import numpy as np
import pytest
from pyspark.sql import functions as F

from derivata.operators import features
from derivata.plans import methods
from derivata.shipping import ship

FRAMES = "array<struct<points: array<array<double>>, descriptors: array<binary>>>"


def test_cosine_basis_is_orthonormal():
    b = features.cosine_basis(32)
    assert np.allclose(b @ b.T, np.eye(32))


def test_hashes_survive_brightness(spark):
    ship(spark)
    r = np.random.default_rng(1)
    x = np.kron(r.uniform(0, 200, (16, 16)), np.ones((4, 4)))
    rows = [(x.ravel().tolist(),), ((x + 20).ravel().tolist(),), ([1.0],), (None,)]
    a, b, c, d = (row.h for row in spark.createDataFrame(rows, "g array<double>").select(features.perceptual_hash(F.col("g")).alias("h")).collect())
    assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and c is None and d is None


def test_spectral_bands(spark):
    ship(spark)
    tone = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    bands = features.spectral_bands(tone[None])[0]
    assert len(bands) == 16 and sum(bands) == pytest.approx(1) and np.argmax(bands) == 0
    r = np.random.default_rng(4)
    clips = [tone, tone[:100], r.normal(size=256), r.normal(size=1000), r.normal(size=1000), r.normal(size=90_000)]
    got = [x.b for x in spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(clips)] + [(9, None)], "i int, s array<double>").orderBy("i").select(features.spectral_landmarks(F.col("s")).alias("b")).collect()]
    assert got[1] == [] and got[6] is None
    for i in (0, 2, 3, 4, 5):
        assert got[i] == pytest.approx(plain_bands(clips[i]), rel=1e-9)


def plain_bands(samples, rate=16_000):
    """Means of sixteen nearly equal parts of the magnitude spectrum, as shares."""
    spectrum = [abs(x) for x in np.fft.rfft(samples[: 5 * rate])]
    n, parts, at = len(spectrum), [], 0
    for k in range(16):
        size = n // 16 + (k < n % 16)
        parts.append(sum(spectrum[at : at + size]) / size)
        at += size
    return [p / (sum(parts) + 1e-9) for p in parts]


def plain_hash(image):
    """Half the size by fixed-point triangle filters of four taps, then the DCT and its median, value by value."""
    n = len(image) // 2

    def reduced(line):
        out = []
        for k in range(n):
            taps = {x: max(0.0, 1 - abs(x + 0.5 - (2 * k + 1)) / 2) for x in range(2 * k - 1, 2 * k + 3) if 0 <= x < 2 * n}
            whole = sum(taps.values())
            total = sum(int(0.5 + w / whole * (1 << 22)) * int(line[x]) for x, w in taps.items())
            out.append(min(255, max(0, (total + (1 << 21)) >> 22)))
        return out

    rows = [reduced(line) for line in image]
    small = list(zip(*[reduced(column) for column in zip(*rows)]))
    c = lambda k, x: np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * (np.sqrt(1 / n) if k == 0 else np.sqrt(2 / n))
    low = [0.0 if (u, v) == (0, 0) else sum(c(u, y) * c(v, x) * small[y][x] for y in range(n) for x in range(n)) for u in range(8) for v in range(8)]
    ordered = sorted(low)
    value = int("".join("1" if x > (ordered[31] + ordered[32]) / 2 else "0" for x in low), 2)
    return value - (1 << 64) if value >> 63 else value


def test_hashes_equal_a_plain_version(spark):
    ship(spark)
    r = np.random.default_rng(7)
    smooth = lambda: np.clip(np.kron(r.uniform(0, 255, (8, 8)), np.ones((8, 8))) + r.normal(0, 9, (64, 64)), 0, 255).astype(np.uint8)
    images = [smooth() for _ in range(6)]
    rows = [(i, x.ravel().tolist()) for i, x in enumerate(images)] + [(7, None), (8, [1, 2])]
    got = [x.h for x in spark.createDataFrame(rows, "i int, g array<int>").orderBy("i").select(features.perceptual_hash(F.col("g")).alias("h")).collect()]
    assert got == [*map(plain_hash, images), None, None]


def test_blocks_chain_within_a_frame(spark):
    rows = [(1, 1, i, j, s, 7) for i, j, s in ((0, 4, 0.2), (1, 5, 0.9), (2, 7, 0.15), (3, 6, 0.5), (4, 7, 0.1), (5, 8, 0.3))]
    got = features.chained_blocks(spark.createDataFrame(rows, "cand bigint, src bigint, i int, j int, frame_score double, inliers bigint")).first()
    assert [(b.source.a, b.source.b, b.candidate.a, b.candidate.b) for b in got.blocks] == [(4, 8, 0, 3), (6, 7, 3, 4), (8, 9, 5, 6)] and got.inliers == 35


def scene(r, n=60):
    return r.uniform([0, 0], [320, 180], (n, 2)), r.integers(0, 256, (n, 32), dtype=np.uint8)


def frame(points, descriptors):
    return {"points": points.tolist(), "descriptors": [d.tobytes() for d in descriptors]}


def test_geometry_finds_the_scene(spark):
    ship(spark)
    r = np.random.default_rng(2)
    scenes = [scene(r) for _ in range(4)]
    source = [frame(p, d) for p, d in scenes]
    turn = np.array([[0.96, -0.2], [0.2, 0.96]])
    candidate = [frame(p @ turn.T + [5, -3], d ^ (np.arange(32) == 0).astype(np.uint8)) for p, d in scenes[1:3]]
    other = [frame(*scene(r)) for _ in range(2)]
    empty = [{"points": [], "descriptors": []}]
    rows = [(1, 1, candidate, source), (2, 1, other, source), (3, 1, candidate, empty), (4, 1, empty, source)]
    df = spark.createDataFrame(rows, f"cand bigint, src bigint, candidate {FRAMES}, source {FRAMES}")
    got = {x.cand: x for x in features.geometric_scores(df).collect()}
    assert got[1].score > 0.9 and [(b.source.a, b.source.b, b.candidate.a, b.candidate.b) for b in got[1].blocks] == [(1, 3, 0, 2)]
    assert got[2].score == 0 and got[2].blocks == [] and got[3].status == "not_evaluated" and got[4].score == 0
    support = [x.s for x in df.orderBy("cand").select(features.descriptor_support(F.col("candidate"), F.col("source")).alias("s")).collect()]
    assert support[1] == support[2] == support[3] == 0


def test_matchability(spark):
    rows = [([[0, 0, 0], [40, 40, 40]],), ([[0, 40, 0]],), ([],)]
    got = [x.m for x in spark.createDataFrame(rows, "f array<array<int>>").select(features.visual_matchability(F.col("f")).alias("m")).collect()]
    assert got == [pytest.approx(0.6), pytest.approx(0.4), None]


def test_methods_and_leads(spark):
    pairs = spark.createDataFrame([([1, 2], [1, 2, 3])], "candidate array<bigint>, source array<bigint>")
    assert methods.verify("V-A", pairs).first().score == 1.0 and methods.verify("transcript", pairs).first().status == "not_evaluated"
    with pytest.raises(ValueError):
        methods.verify("none", pairs)
    scores = spark.createDataFrame([("c", "V-C", f"p{i}", i / 10, [1, 2, 3]) for i in range(8)] + [("c", "V-A", "p", 1.0, []), ("c", "A-chromaprint", "p", 0.0, [])], "candidate string, method string, parent string, score double, blocks array<int>")
    assert sorted(r.parent for r in methods.leads(scores, blocks=2).collect()) == ["p3", "p4", "p5", "p6", "p7"]
    iv = lambda *x: F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in x])
    got = spark.range(1).select(methods.valid_intervals(iv((0, 2)), F.lit(5.0)), methods.valid_intervals(iv((0, 6)), F.lit(5.0)), methods.valid_review(F.lit("insufficient"), F.lit(" ")), methods.valid_period(F.lit(1), F.lit(2))).first()
    assert tuple(got) == (True, False, False, True)


def test_leads_have_one_order(spark):
    rows = [("c", "V-C", "b", 0.5), ("c", "V-C", "a", 0.5), ("c", "A-chromaprint", "a", 0.5), ("c", "A-chromaprint", "z", 0.9)]
    df = spark.createDataFrame(rows, "candidate string, method string, parent string, score double").withColumn("blocks", F.array(F.lit(1)))
    got = methods.leads(df).orderBy("position").collect()
    assert [(r.parent, r.method, r.position) for r in got] == [("z", "A-chromaprint", 1), ("a", "A-chromaprint", 2), ("a", "V-C", 3), ("b", "V-C", 4)]
