import random

import pytest

from derivata.operators import alignment, long_alignment
from derivata.shipping import ship


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def count(x):
    return (x & ((1 << 64) - 1)).bit_count()


def plain(clip, source):
    sums = [sum(count(a ^ b) for a, b in zip(clip, source[o : o + len(clip)])) for o in range(len(source) - len(clip) + 1)] if clip else []
    return (min(sums), sums.index(min(sums))) if sums else (None, None)


def material(seed):
    r = random.Random(seed)
    hashes = lambda n: [signed(r.getrandbits(64)) for _ in range(n)]
    sources = {0: hashes(300), 1: hashes(90), 2: [0] * 50 + hashes(40) + [0] * 120, 3: hashes(3), 4: hashes(64) * 2}
    near = lambda x, n: [signed((h ^ sum(1 << b for b in r.sample(range(64), n))) & ((1 << 64) - 1)) for h in x]
    clips = {0: sources[0][60:70], 1: near(sources[1][5:12], 2), 2: near(sources[2][48:60], 5), 3: hashes(8), 4: [], 5: [0] * 6, 6: sources[0][200:205] + sources[0][20:25], 7: sources[4][60:70], 8: near(sources[0][31:36], 3)}
    return clips, sources


@pytest.mark.parametrize("size,common", [(16, 10_000), (64, 30), (4096, 5)])
def test_equals_all_offsets(spark, size, common):
    ship(spark)
    clips, sources = material(size)
    frames = spark.createDataFrame([(s, i, h) for s, x in sources.items() for i, h in enumerate(x)], "src bigint, pos bigint, hash bigint")
    candidates = spark.createDataFrame(list(clips.items()), "cand bigint, candidate array<bigint>")
    pairs = candidates.select("cand").crossJoin(frames.select("src").distinct())
    got = long_alignment.placed(pairs, candidates, frames, 12, size, common).collect()
    assert {(r.cand, r.src): (r.total, r.offset) for r in got} == {(c, s): plain(x, y) for c, x in clips.items() for s, y in sources.items()}
    assert {r.how for r in got} >= {"seeds", "scan"} and len(got) == 45


def test_equals_the_alignment_of_whole_rows(spark):
    ship(spark)
    clips, sources = material(5)
    frames = spark.createDataFrame([(s, i, h) for s, x in sources.items() for i, h in enumerate(x)], "src bigint, pos bigint, hash bigint")
    candidates = spark.createDataFrame(list(clips.items()), "cand bigint, candidate array<bigint>")
    pairs = candidates.select("cand").crossJoin(frames.select("src").distinct())
    whole = spark.createDataFrame([(c, s, x, y) for c, x in clips.items() for s, y in sources.items()], "cand bigint, src bigint, candidate array<bigint>, source array<bigint>")
    names = ("cand", "src", "status", "mean_distance", "source_intervals", "candidate_intervals", "n_fragments")
    got = long_alignment.aligned(pairs, candidates, frames, 12, size=32).select(*names).collect()
    want = alignment.align(whole).select(*names).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.n_fragments for r in got} == {0, 1, 2}


def test_a_source_of_many_frames_is_no_row(spark):
    ship(spark)
    n = 100_000
    frames = spark.range(n).selectExpr("7L AS src", "id AS pos", "xxhash64(id) AS hash")
    clip = [r.hash for r in frames.where("pos BETWEEN 77777 AND 77792").orderBy("pos").collect()]
    candidates = spark.createDataFrame([(1, clip), (2, [h ^ 5 for h in clip])], "cand bigint, candidate array<bigint>")
    got = long_alignment.placed(candidates.selectExpr("cand", "7L AS src"), candidates, frames, 16).collect()
    assert {(r.cand, r.total, r.offset, r.how) for r in got} == {(1, 0, 77777, "seeds"), (2, 32, 77777, "seeds")}
    rows = long_alignment.chunked(frames, 15).selectExpr("size(frames) AS n", "first").collect()
    assert max(r.n for r in rows) == long_alignment.CHUNK + 15 and len(rows) == 25


def test_clips_beyond_the_bound_are_refused(spark):
    ship(spark)
    frames = spark.createDataFrame([(0, 0, 1)], "src bigint, pos bigint, hash bigint")
    candidates = spark.createDataFrame([(0, [1, 2, 3])], "cand bigint, candidate array<bigint>")
    with pytest.raises(Exception, match="more than 2 frames"):
        long_alignment.placed(candidates.selectExpr("cand", "0L AS src"), candidates, frames, 2).collect()
    assert long_alignment.placed(candidates.selectExpr("cand", "0L AS src").limit(0), candidates, frames, 4).collect() == []
