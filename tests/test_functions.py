import math
import random

import pytest
from pyspark.sql import functions as F

from derivata.functions import bits, canonical, signatures, statistics
from derivata.functions import intervals as iv
from derivata.shipping import ship

PAIRS = "array<struct<a:double,b:double>>"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def pairs(*x):
    return F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in x]).cast(PAIRS) if x else F.array().cast(PAIRS)


def test_hashes_and_distances(spark):
    r = random.Random(1)
    rows = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(200)] + [(0, 2**64 - 1), (2**63, 0)]
    df = spark.createDataFrame([(f"{a:016x}", f"{b:016x}") for a, b in rows], "a string, b string")
    got = df.select(bits.hamming_hex(F.col("a"), F.col("b")).alias("d"), bits.hash_to_hex(bits.hash_from_hex(F.col("a"))).alias("h"), "a").collect()
    assert [g.d for g in got] == [(a ^ b).bit_count() for a, b in rows] and all(g.h == g.a for g in got)
    assert one(spark, bits.hamming_hex(F.lit("zz"), F.lit("0")), bits.hamming_hex(F.lit(None).cast("string"), F.lit("0"))) == (64, 64)
    assert one(spark, bits.hamming32(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))) == (31,)
    assert one(spark, bits.score64(F.lit(8)), bits.score64(F.lit(40)), bits.score32(F.lit(4))) == (0.75, 0.0, 0.75)


def test_hash_of_coefficients(spark):
    r = random.Random(2)
    for _ in range(3):
        v = [r.uniform(-1, 1) for _ in range(64)]
        flat = [0.0, *v[1:]]
        s = sorted(flat)
        want = "".join("1" if x > (s[31] + s[32]) / 2 else "0" for x in flat)
        got = one(spark, bits.hash_to_hex(bits.hash_from_coefficients(F.array(*map(F.lit, v)))))[0]
        assert got == f"{int(want, 2):016x}"
    assert one(spark, bits.hash_from_coefficients(F.array(F.lit(1.0)))) == (None,)


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    assert one(spark, bits.cosine(v(1.0, 0.0), v(1.0, 0.0)))[0] == pytest.approx(1)
    assert one(spark, bits.cosine(v(1.0, 0.0), v(-1.0, 0.0)), bits.cosine(v(1.0), v(1.0, 2.0)), bits.cosine(v(), v())) == (0.0, None, None)


@pytest.mark.parametrize(
    ("claimed", "truth", "iou", "start", "end"),
    [([(0, 10)], [(0, 10)], 1, 0, 0), ([(0, 5)], [(0, 10)], 0.5, 0, 5), ([], [(0, 1)], 0, None, None), ([], [], 1, None, None), ([(1, 5)], [(0, 6)], 4 / 6, 1, 1), ([(0, 5)], [(0, 5), (10, 15)], 0.5, 0, 10), ([(5, 9), (0, 6)], [(0, 9)], 1, 0, 0)],
)
def test_interval_measures(spark, claimed, truth, iou, start, end):
    c, t = pairs(*claimed), pairs(*truth)
    got = one(spark, iv.iou(c, t), iv.start_error(c, t), iv.end_error(c, t))
    assert got == (pytest.approx(iou), start, end)


def test_merge_and_padding(spark):
    got = one(spark, iv.merge(pairs((5, 6), (0, 2), (2, 3))), iv.merge(pairs((5, 6), (0, 2), (2, 3)), 2), iv.padding_inflation(pairs((0, 20)), pairs((0, 10))), iv.padding_inflation(pairs((0, 20)), pairs()))
    assert [tuple(x) for x in got[0]] == [(0, 3), (5, 6)] and [tuple(x) for x in got[1]] == [(0, 6)] and got[2:] == (2.0, None)
    assert one(spark, iv.false_continuous(F.lit(1), F.lit(2)), iv.false_continuous(F.lit(2), F.lit(2)), iv.false_continuous(F.lit(1), F.lit(1)), iv.fragmentation_error(F.lit(1), F.lit(2))) == (True, False, False, 1)


def test_merge_blocks(spark):
    block = lambda a, b, c, d: F.struct(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")).alias("source"), F.struct(F.lit(float(c)).alias("a"), F.lit(float(d)).alias("b")).alias("candidate"))
    got = one(spark, iv.merge_blocks(F.array(block(0, 3, 0, 3), block(4, 7, 3, 6), block(20, 23, 6, 9))))[0]
    assert [(x.source.a, x.source.b, x.candidate.a, x.candidate.b) for x in got] == [(0, 7, 0, 6), (20, 23, 6, 9)]


def test_statistics(spark):
    assert one(spark, statistics.rate(F.lit(1), F.lit(0)), statistics.rate(F.lit(1), F.lit(4))) == (None, 0.25)
    array = F.array(*map(F.lit, range(10)))
    assert one(spark, *[statistics.nearest_rank(array, p) for p in (0.1, 0.5, 0.9)]) == (1, 4, 8)
    assert statistics.binomial_interval(0, 0) is None
    lo, hi = statistics.binomial_interval(0, 10)
    assert lo == 0 and hi == pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-9)
    lo, hi = statistics.binomial_interval(5, 10)
    tail = sum(math.comb(10, k) * lo**k * (1 - lo) ** (10 - k) for k in range(5, 11))
    assert tail == pytest.approx(0.025, abs=1e-9) and lo + hi == pytest.approx(1, abs=1e-9)


def test_canonical_forms(spark):
    ship(spark)
    assert canonical.digest_of({"b": 2, "a": 1}) == canonical.digest_of({"a": 1, "b": 2})
    assert canonical.canonical_json({"é": None}) == '{"é":null}' and canonical.canonical_json({"é": 1}, True) == '{"\\u00e9":1}'
    with pytest.raises(ValueError):
        canonical.canonical_json({"x": float("nan")})
    assert one(spark, canonical.canonical_column(F.lit('{"b": [1, null], "a": "é"}'))) == ('{"a":"é","b":[1,null]}',)
    assert one(spark, canonical.is_digest(F.lit("a" * 64)), canonical.is_digest(F.lit("A" * 64)), canonical.is_digest(F.lit(None).cast("string"))) == (True, False, False)
    stamps = one(spark, *[canonical.stamp(F.lit(x)).isNotNull() for x in ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05", "x")])
    assert stamps == (True, True, False, False)
    assert one(spark, canonical.base_name(F.lit("/a/b\\c.mp4")), canonical.padded_id("E", F.lit(7), 5), canonical.three_decimals(F.lit(0.5)), canonical.three_decimals(F.lit(None).cast("double"))) == ("c.mp4", "E00007", "0.500", "not evaluated")
    assert one(spark, canonical.frame_times(F.lit(2.2), 2.0, 64), canonical.frame_times(F.lit(0.0), 2.0, 64)) == ([0.0, 0.5, 1.0, 1.5, 2.0], [])


def test_signatures(spark):
    """The first test vectors of RFC 8032."""
    import base64

    ship(spark)
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    signature = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert signatures.public_key(seed) == key and signatures.sign(seed, b"") == signature and signatures.verify(key, b"", signature)
    assert not signatures.verify(key, b"x", signature) and not signatures.verify(key[:5], b"", signature)
    b64 = lambda x: base64.b64encode(x).decode()
    df = spark.createDataFrame([("m", b64(key), b64(signatures.sign(seed, b"m"))), ("n", b64(key), b64(signatures.sign(seed, b"m"))), ("m", "!", None)], "m string, k string, s string")
    assert [r.v for r in df.select(signatures.verified(F.col("m"), F.col("k"), F.col("s")).alias("v")).collect()] == [True, False, False]


def test_signing_and_verifying_by_tables(spark, monkeypatch):
    seed = bytes(range(32))
    key, other = signatures.public_key(seed), signatures.public_key(bytes(range(1, 33)))
    good = signatures.sign(seed, b"m")
    assert signatures.verify(key, b"m", good)
    added = []
    monkeypatch.setattr(signatures, "_add", lambda p, q: added.append(1))
    # Tables stand now, so no point is doubled again.
    assert signatures.sign(seed, b"m") == good and signatures.verify(key, b"m", good) and not signatures.verify(key, b"n", good) and not added
    monkeypatch.undo()
    assert not signatures.verify(other, b"m", good) and signatures.verify(key, b"m", good, signatures.WIDE)
    # A key of order 1 signs anything with s = 0 and the neutral point; no other bytes of that point count.
    neutral, twice = (1).to_bytes(32, "little"), (1 + signatures.P).to_bytes(32, "little")
    assert signatures.verify(neutral, b"m", neutral + bytes(32)) and not signatures.verify(neutral, b"m", twice + bytes(32)) and not signatures.verify(twice, b"m", neutral + bytes(32))
    text = signatures.signed(F.lit('{"a":1}'), seed)
    used = spark.range(1).withColumn("e", text).select("e", signatures.sound_column(F.col("e")).alias("s"))
    assert used.first().s and used._jdf.queryExecution().optimizedPlan().toString().count("run(") == 2
