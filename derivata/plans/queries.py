"""Registered queries, one an operator or a small composition, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, canonical
from ..functions import intervals as iv
from ..functions.ordinals import checkpointed, numbered
from ..functions.statistics import binomial_interval_column
from ..functions import signatures
from ..operators import accounting, alignment, calibration, decisions, evidence, features, hamming, partitioning, registry, retrieval, tree
from ..operators import long_alignment as long
from ..operators.design import design, first_candidates, zipped_intervals
from ..functions.shared import new_folder
from ..sources import readers, sinks
from ..streaming import ledger, scoring
from . import fixtures as fx
from . import methods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {fx.HASHES} SELECT id, label::BIGINT AS label, format('{{:016x}}', hash) AS hash FROM hashes")
def hash_tail(spark, d):
    return fx.hashes(spark, d).select("id", F.col("label").cast("bigint"), bits.hash_to_hex(F.col("hash")).alias("hash"))


_TOP = f"""WITH {fx.HASHES}, p AS (SELECT a.id AS candidate, b.id AS parent, bit_count(xor(a.hash, b.hash))::BIGINT AS distance FROM hashes a, hashes b WHERE a.id % 100 = 0 AND b.id <> a.id),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY distance, parent) AS rank FROM p), top AS (SELECT candidate, parent, distance, rank::BIGINT AS rank FROM r WHERE rank <= 10)"""


def _top(spark, d):
    h = fx.hashes(spark, d)
    return retrieval.nearest(h.where("id % 100 = 0"), h, 10, others=True)


@query(f"{_TOP} SELECT candidate, parent, distance, rank FROM top")
def retrieval_top_k(spark, d):
    return _top(spark, d).select("candidate", "parent", "distance", F.col("rank").cast("bigint"))


@query(f"{_TOP} SELECT a.candidate, a.parent AS top_parent, greatest(0, 32 - a.distance)::BIGINT AS score_32nds, (greatest(0, 32 - a.distance) - greatest(0, 32 - b.distance))::BIGINT AS margin_32nds, CASE WHEN (greatest(0, 32 - a.distance) - greatest(0, 32 - b.distance)) / 32.0 < 0.08 THEN 'AMBIGUOUS' ELSE 'ranked' END AS disposition FROM top a JOIN top b ON a.candidate = b.candidate AND a.rank = 1 AND b.rank = 2")
def retrieval_margin(spark, d):
    top = _top(spark, d).withColumn("score", bits.score64(F.col("distance")))
    m = retrieval.margins(top, ["candidate"])
    return m.select("candidate", "top_parent", F.round(F.col("score") * 32).cast("bigint").alias("score_32nds"), F.round(F.col("margin") * 32).cast("bigint").alias("margin_32nds"), retrieval.disposition(F.col("margin"), F.lit(2)).alias("disposition"))


@query(f"{_TOP}, t AS (SELECT a.id AS candidate, min(b.id) AS parent FROM hashes a JOIN hashes b ON a.label = b.label AND a.id % 100 = 0 AND b.id <> a.id GROUP BY a.id), h AS (SELECT t.candidate, min(top.rank) AS rank FROM t LEFT JOIN top ON top.candidate = t.candidate AND top.parent = t.parent GROUP BY t.candidate) SELECT k::BIGINT AS k, count(*) FILTER (WHERE rank <= k)::BIGINT AS hits, count(*)::BIGINT AS n FROM h, (VALUES (1), (5), (10)) ks(k) GROUP BY k")
def retrieval_recall(spark, d):
    return retrieval.recall_at(_top(spark, d), _true_parents(fx.hashes(spark, d)))


def _true_parents(h):
    """(candidate, parent) of the queries: the least other id of the same label."""
    parent = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("parent")
    return h.where("id % 100 = 0").join(retrieval.least_ids(h, "label"), "label").where("n > 1").select(F.col("id").alias("candidate"), parent)


@query(f"{_TOP}, t AS (SELECT DISTINCT candidate, parent FROM top WHERE rank <= 3 UNION SELECT a.id, min(b.id) FROM hashes a JOIN hashes b ON a.label = b.label AND a.id % 100 = 0 AND b.id <> a.id GROUP BY a.id) SELECT candidate, count(*)::BIGINT AS n_targets FROM t GROUP BY candidate")
def target_sets(spark, d):
    truth = _true_parents(fx.hashes(spark, d))
    return retrieval.target_set(_top(spark, d), truth, 3).groupBy("candidate").agg(F.count("*").alias("n_targets"))


@query(f"""WITH {fx.HASHES}, {fx.NEAR}, c AS (SELECT hash, min(id) AS class_id, count(*) AS n FROM near GROUP BY hash),
l AS (SELECT a.class_id, sum(b.n) AS beyond, min(bit_count(xor(a.hash, b.hash))) AS nearest FROM c a JOIN c b ON a.hash <> b.hash AND bit_count(xor(a.hash, b.hash)) <= 3 GROUP BY a.class_id)
SELECT near.id, c.class_id, (c.n - 1 + coalesce(beyond, 0))::BIGINT AS n_links, nearest::BIGINT AS nearest FROM near JOIN c ON c.hash = near.hash LEFT JOIN l ON l.class_id = c.class_id""")
def banded_join(spark, d):
    return retrieval.near_links(fx.near_hashes(spark, d), 3)


def _assets(spark, d):
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))


_ASSETS = "assets AS (SELECT doc_id AS id, sha256(text) AS sha256 FROM documents)"


@query(f"WITH {_ASSETS} SELECT c.id AS candidate, count(DISTINCT a.id)::BIGINT AS n_parents, min(a.id) AS first_parent FROM assets c JOIN assets a ON a.sha256 = c.sha256 AND c.id % 100 = 0 AND a.id <> c.id GROUP BY c.id")
def exact_join(spark, d):
    a = _assets(spark, d)
    return retrieval.exact_matches(a.where("id % 100 = 0"), a, others=True)


@query(f"WITH {_ASSETS} SELECT id FROM assets c WHERE id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.id <> c.id AND a.sha256 = c.sha256)")
def anti_join(spark, d):
    a = _assets(spark, d)
    return retrieval.unmatched(a.where("id % 100 = 0"), a, others=True).select("id")


@query(f"WITH {_ASSETS} SELECT sha256, count(DISTINCT id)::BIGINT AS n_ids, min(id) AS first_id FROM assets GROUP BY sha256 HAVING count(DISTINCT id) > 1")
def registration_conflicts(spark, d):
    return retrieval.conflicts(_assets(spark, d))


_SLIDE = f"""WITH {fx.PAIRS}, offs AS (SELECT p.cand, p.src, p.n, p.m, o.off FROM pairs p, (SELECT unnest(range(0, {fx.FRAMES})) AS off) o WHERE o.off <= p.m - p.n),
sums AS (SELECT o.cand, o.src, o.n, o.off, sum(bit_count(xor(c.hash, f.hash)))::BIGINT AS total FROM offs o JOIN cands c ON c.seq = o.cand JOIN frames f ON f.seq = o.src AND f.pos = o.off + c.pos GROUP BY ALL),
best AS (SELECT cand, src, n, min(total) AS total, arg_min(off, total * 1000 + off) AS off FROM sums GROUP BY cand, src, n)"""


@query(f"{_SLIDE} SELECT cand, src, total, off::BIGINT AS off FROM best")
def sliding_alignment(spark, d):
    return alignment.slide_all(*fx.sides(spark, d)).where("best IS NOT NULL").select("cand", "src", "best.total", F.col("best.offset").cast("bigint").alias("off"))


@query(f"""WITH {fx.PAIRS}, h AS (SELECT seq, hash, pos, n, CASE WHEN pos < n // 2 THEN 0 ELSE 1 END AS half FROM cands),
g AS (SELECT seq, half, count(*) AS k, min(pos) AS lo FROM h GROUP BY seq, half),
sums AS (SELECT p.cand, p.src, g.half, g.k, o.off, sum(bit_count(xor(h.hash, f.hash)))::BIGINT AS total FROM pairs p JOIN g ON g.seq = p.cand JOIN (SELECT unnest(range(0, {fx.FRAMES})) AS off) o ON o.off <= p.m - g.k JOIN h ON h.seq = p.cand AND h.half = g.half JOIN frames f ON f.seq = p.src AND f.pos = o.off + h.pos - g.lo GROUP BY ALL),
hb AS (SELECT cand, src, half, k, min(total) / k AS mean, arg_min(off, total * 1000 + off) AS off FROM sums GROUP BY cand, src, half, k),
ws AS (SELECT p.cand, p.src, p.n, o.off, sum(bit_count(xor(c.hash, f.hash)))::BIGINT AS total FROM pairs p JOIN (SELECT unnest(range(0, {fx.FRAMES})) AS off) o ON o.off <= p.m - p.n JOIN cands c ON c.seq = p.cand JOIN frames f ON f.seq = p.src AND f.pos = o.off + c.pos GROUP BY ALL),
w AS (SELECT cand, src, n, min(total) AS total, arg_min(off, total * 1000 + off) AS off FROM ws GROUP BY cand, src, n),
j AS (SELECT p.cand, p.src, p.n, w.total, w.off, a.off / 2.0 AS s0, (a.off + a.k) / 2.0 AS e0, b.off / 2.0 AS s1, a.mean <= 40 AND b.mean <= 40 AND p.n >= 4 AS placed FROM pairs p LEFT JOIN w ON w.cand = p.cand AND w.src = p.src LEFT JOIN hb a ON a.cand = p.cand AND a.src = p.src AND a.half = 0 LEFT JOIN hb b ON b.cand = p.cand AND b.src = p.src AND b.half = 1)
SELECT cand, src, CASE WHEN total IS NULL THEN 'not_evaluated' WHEN total / n > 40 THEN 'insufficient' ELSE 'ok' END AS status, (CASE WHEN total IS NULL OR total / n > 40 THEN 0 WHEN placed AND (abs(s1 - s0) > n / 2.0 * 1.3 OR abs(s1 - e0) > 1) THEN 2 ELSE 1 END)::BIGINT AS n_fragments, (CASE WHEN total IS NULL OR total / n > 40 THEN NULL WHEN placed AND (abs(s1 - s0) > n / 2.0 * 1.3 OR abs(s1 - e0) > 1) THEN least(s0, s1) ELSE off / 2.0 END)::DOUBLE AS first_start FROM j""")
def fragment_alignment(spark, d):
    a = alignment.align_all(*fx.sides(spark, d), fps=2.0, most=40.0)
    return a.select("cand", "src", "status", F.col("n_fragments").cast("bigint"), "first_start")


@query(f"{_SLIDE.replace('xor(c.hash, f.hash)', 'xor(c.hash, f.hash) & 4294967295::UBIGINT')} SELECT cand, src, total, off::BIGINT AS off FROM best")
def fingerprint_alignment(spark, d):
    return alignment.slide_all(*fx.sides(spark, d), bits_of=32).where("best IS NOT NULL").select("cand", "src", "best.total", F.col("best.offset").cast("bigint").alias("off"))


@query(f"WITH {fx.PAIRS}, b AS (SELECT p.cand, p.src, c.pos, p.n, min(bit_count(xor(c.hash, f.hash))) AS x FROM pairs p JOIN cands c ON c.seq = p.cand JOIN frames f ON f.seq = p.src GROUP BY ALL) SELECT cand, src, round(sum(greatest(0, 32 - x)) / (32.0::DOUBLE * n), 6) AS score FROM b GROUP BY cand, src, n")
def frame_matrix(spark, d):
    return alignment.coarse_all(*fx.sides(spark, d)).select("cand", "src", F.round("score", 6).alias("score"))


#: A clip is eight frames of a sequence from place seq % 4 on, at one of four speeds, every third of them with other bits.
_WARPED = f"""WITH {fx.HASHES}, f AS (SELECT id // {fx.FRAMES} AS seq, row_number() OVER (PARTITION BY id // {fx.FRAMES} ORDER BY id) - 1 AS pos, hash FROM hashes),
c AS (SELECT f.seq, i, CASE WHEN i % 3 = 2 THEN xor(hash, 4095::UBIGINT) ELSE hash END AS hash, count(*) OVER (PARTITION BY f.seq) AS n FROM (SELECT unnest(range(8)) AS i) t JOIN f ON f.pos = f.seq % 4 + round_even(i * [0.75, 1.0, 1.25, 1.5][f.seq // 4 % 4 + 1], 0)),
u AS (SELECT seq AS cand, seq + d AS src, n FROM (SELECT DISTINCT seq, n FROM c), (VALUES (0), (1)) t(d) WHERE seq + d IN (SELECT seq FROM f)),
sp AS (SELECT * FROM (VALUES (0, 0.75), (1, 1.0), (2, 1.25), (3, 1.5)) t(j, speed)),
k AS (SELECT u.cand, u.src, u.n, b, least(3, u.n - 3 * b) AS len, j, speed, o FROM u, (SELECT unnest(range(3)) AS b) bs, sp, (SELECT unnest(range({fx.FRAMES})) AS o) os WHERE 3 * b < u.n),
l AS (SELECT k.*, x.i, x.hash AS mine, y.hash AS theirs, lag(x.hash) OVER w AS mine0, lag(y.hash) OVER w AS theirs0 FROM k JOIN c x ON x.seq = k.cand AND x.i BETWEEN 3 * b AND 3 * b + len - 1 JOIN f y ON y.seq = k.src AND y.pos = o + round_even((x.i - 3 * b) * speed, 0) WINDOW w AS (PARTITION BY k.cand, k.src, b, j, o ORDER BY x.i)),
val AS (SELECT cand, src, n, b, len, j, speed, o, CASE len WHEN 3 THEN 14 WHEN 2 THEN 7 ELSE 1 END * sum(greatest(0, 32 - bit_count(xor(mine, theirs)))) + CASE len WHEN 3 THEN 9 WHEN 2 THEN 6 ELSE 0 END * coalesce(sum(greatest(0, 32 - bit_count(xor(xor(mine, mine0), xor(theirs, theirs0))))), 0) AS value FROM l GROUP BY cand, src, n, b, len, j, speed, o HAVING count(*) = len),
p AS (SELECT *, value / CASE len WHEN 3 THEN 1920.0::DOUBLE WHEN 2 THEN 640 ELSE 32 END AS score FROM val QUALIFY row_number() OVER (PARTITION BY cand, src, b ORDER BY value DESC, j, o) = 1),
i AS (SELECT seq, least(1, (count(DISTINCT hash) - 1) / 2) AS info FROM c GROUP BY seq)"""


@query(f"{_WARPED} SELECT u.cand, u.src, round(coalesce(sum(score * len), 0) / u.n * any_value(info), 9) AS score, count(*) FILTER (WHERE score >= 0.55)::INTEGER AS n_kept, coalesce(string_agg(3 * b || ':' || o || ':' || (speed * 100)::INTEGER, ' ' ORDER BY b) FILTER (WHERE score >= 0.55), '') AS places FROM u JOIN i ON i.seq = u.cand LEFT JOIN p ON p.cand = u.cand AND p.src = u.src GROUP BY u.cand, u.src, u.n")
def warped_alignment(spark, d):
    """Every sequence's clip against its own sequence and the next one."""
    s = fx.sequences(spark, d)
    speed = F.element_at(F.array(*map(F.lit, alignment.SPEEDS)), (F.floor(F.col("seq") / 4) % 4 + 1).cast("int"))
    at = lambda i: (F.col("seq") % 4 + F.rint(i * speed)).cast("int")
    frame = lambda i: F.when(i % 3 == 2, F.get("frames", at(i)).bitwiseXOR(F.lit(4095))).otherwise(F.get("frames", at(i)))
    clip = F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), frame), lambda h: h.isNotNull())
    clips = s.select(F.col("seq").alias("cand"), clip.alias("candidate"), F.explode(F.array(F.col("seq"), F.col("seq") + 1)).alias("src")).where(F.size("candidate") > 0)
    pairs = clips.join(s.select(F.col("seq").alias("src"), F.col("frames").alias("source")), "src")
    out = alignment.warped(pairs.withColumns({"source_s": F.size("source").cast("double"), "candidate_s": F.size("candidate").cast("double")}))
    kept = F.filter("places", lambda b: F.coalesce(b["best"]["score"] >= 0.55, F.lit(False)))
    named = F.transform(kept, lambda b: F.concat_ws(":", b["lo"].cast("string"), b["best"]["offset"].cast("string"), (b["best"]["speed"] * 100).cast("int").cast("string")))
    return out.select("cand", "src", F.round("score", 9).alias("score"), F.size(kept).alias("n_kept"), F.array_join(named, " ").alias("places"))


@query("SELECT a.vec_id AS id, round(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = fx.table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("id"), F.round(bits.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _decided(spark, d):
    return fx.scored(spark, d).withColumn("decision", decisions.decision(F.lit(fx.THRESHOLD), F.lit(fx.MINIMUM)))


@query(f"WITH {fx.DECIDED} SELECT candidate_id, method, state, parent, processing AS processing_state, reason FROM states")
def decision_states(spark, d):
    return _decided(spark, d).select("candidate_id", "method", "decision.*")


def _wide(spark, d):
    s = _decided(spark, d)
    v = s.where("method = 'V-C'").select("candidate_id", "visual_ancestry", "audio_ancestry", F.col("decision").alias("v"), F.col("score").alias("vs"))
    a = s.where("method = 'A-chromaprint'").select("candidate_id", F.col("decision").alias("a"), F.col("score").alias("as"))
    return v.join(a, "candidate_id")


_WIDE = f"WITH {fx.DECIDED}, w AS (SELECT v.candidate_id, v.visual_ancestry AS va, v.audio_ancestry AS aa, v.state AS v, a.state AS a, v.parent AS vp, a.parent AS ap, v.score AS vs, a.score AS sa FROM states v JOIN states a ON a.candidate_id = v.candidate_id AND v.method = 'V-C' AND a.method = 'A-chromaprint'), c AS (SELECT *, v = 'supported' AND a = 'supported' AND vp IS DISTINCT FROM ap AS conflict FROM w)"
_ROUTED = f"{_WIDE}, routed AS (SELECT *, CASE WHEN conflict THEN 'AMBIGUOUS' WHEN v = 'supported' OR a = 'supported' THEN 'supported' WHEN v = 'AMBIGUOUS' OR a = 'AMBIGUOUS' THEN 'AMBIGUOUS' ELSE 'insufficient' END AS o, CASE WHEN conflict THEN 'AMBIGUOUS' WHEN v = 'supported' AND a = 'supported' THEN 'supported' ELSE 'insufficient' END AS n FROM c)"


@query(f"{_ROUTED} SELECT candidate_id, v AS visual_only, a AS audio_only, o AS visual_or_audio, n AS visual_and_audio, conflict OR (v = 'supported') <> (a = 'supported') AS disagreement, CASE WHEN conflict THEN NULL WHEN v = 'supported' THEN vp WHEN a = 'supported' THEN ap END AS or_parent, CASE WHEN n = 'supported' THEN vp END AS and_parent FROM routed")
def multimodal_routing(spark, d):
    return _wide(spark, d).select("candidate_id", *decisions.route(F.col("v"), F.col("a")))


@query(f"{_ROUTED}, m AS (SELECT 'visual_only' AS mode, va AS t, v = 'supported' AS y FROM routed UNION ALL SELECT 'audio_only', aa, a = 'supported' FROM routed UNION ALL SELECT 'visual_or_audio', va OR aa, o = 'supported' FROM routed UNION ALL SELECT 'visual_and_audio', va AND aa, n = 'supported' FROM routed) SELECT mode, count(*) FILTER (WHERE t AND y)::BIGINT AS tp, count(*) FILTER (WHERE NOT t AND y)::BIGINT AS fp, count(*) FILTER (WHERE NOT t AND NOT y)::BIGINT AS tn, count(*) FILTER (WHERE t AND NOT y)::BIGINT AS fn FROM m GROUP BY mode")
def multimodal_confusion(spark, d):
    routed = _wide(spark, d).select("candidate_id", "visual_ancestry", "audio_ancestry", *decisions.route(F.col("v"), F.col("a")))
    return accounting.multimodal(routed).select("mode", "tp", "fp", "tn", "fn")


@query(f"{_WIDE} SELECT candidate_id, coalesce(vs >= 0.5, false) AS visual_only, coalesce(vs >= 0.5, false) OR coalesce(sa >= 0.5, false) AS either, greatest(vs, sa) AS either_score, coalesce(vs >= 0.5, false) AND coalesce(sa >= 0.5, false) AS both_ok, CASE WHEN vs IS NOT NULL AND sa IS NOT NULL THEN least(vs, sa) END AS both_score, round(CASE WHEN vs IS NOT NULL AND sa IS NOT NULL THEN 0.5::DOUBLE * vs + 0.5::DOUBLE * sa ELSE coalesce(vs, sa) END, 6) AS mean_score FROM w")
def fusion_modes(spark, d):
    v, a = F.col("vs"), F.col("as")
    m = {k: decisions.fuse(v, a, k) for k in ("visual_only", "visual_or_audio", "visual_and_audio", "calibrated")}
    return _wide(spark, d).select("candidate_id", m["visual_only"]["supported"].alias("visual_only"), m["visual_or_audio"]["supported"].alias("either"), m["visual_or_audio"]["score"].alias("either_score"), m["visual_and_audio"]["supported"].alias("both_ok"), m["visual_and_audio"]["score"].alias("both_score"), F.round(m["calibrated"]["score"], 6).alias("mean_score"))


_DECIDED_PAIRS = "p AS (SELECT candidate_id AS candidate, identity || '-' || i AS parent, i, method, round(score * i / 4.0::DOUBLE, 6) AS score FROM scored, (VALUES (1), (2), (3)) t(i) WHERE score IS NOT NULL)"


def _method_pairs(spark, d, method):
    s = fx.scored(spark, d).where((F.col("method") == method) & F.col("score").isNotNull())
    return s.select(F.col("candidate_id").alias("candidate"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i"), "identity", "score").select("candidate", F.concat_ws("-", "identity", F.col("i").cast("string")).alias("parent"), F.round(F.col("score") * F.col("i") / F.lit(4.0), 6).alias("score"))


@query(f"WITH {fx.SCORED}, {_DECIDED_PAIRS}, f AS (SELECT v.candidate, v.parent, 0.25::DOUBLE * v.score + 0.75::DOUBLE * a.score AS score FROM p v JOIN p a ON a.candidate = v.candidate AND a.parent = v.parent AND v.method = 'V-C' AND a.method = 'A-chromaprint'), r AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS margin FROM f WINDOW w AS (PARTITION BY candidate ORDER BY score DESC, parent)) SELECT candidate, parent, rank::BIGINT AS rank, round(score, 6) AS score, round(margin, 6) AS margin FROM r")
def fusion_join(spark, d):
    f = decisions.fused_pairs(_method_pairs(spark, d, "V-C"), _method_pairs(spark, d, "A-chromaprint"), 0.25)
    return f.select("candidate", "parent", F.col("rank").cast("bigint"), F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


def _samples(spark, d):
    return fx.scored(spark, d).select(F.col("method").alias("modality"), "score", F.col("truth").alias("is_positive"))


@query(f"WITH {fx.SCORED}, o AS (SELECT method AS modality, truth AS is_positive, list_sort(list(score)) AS s FROM scored WHERE score IS NOT NULL GROUP BY method, truth) SELECT modality, is_positive, len(s)::BIGINT AS n, s[1] AS min, s[len(s)] AS max, round(list_avg(s), 6) AS mean, s[round_even(0.1 * (len(s) - 1), 0)::BIGINT + 1] AS p10, s[round_even(0.5 * (len(s) - 1), 0)::BIGINT + 1] AS median, s[round_even(0.9 * (len(s) - 1), 0)::BIGINT + 1] AS p90 FROM o")
def score_distributions(spark, d):
    return calibration.distributions(_samples(spark, d), ["modality"]).withColumn("mean", F.round("mean", 6))


_CURVE = f"""WITH {fx.SCORED}, s AS (SELECT method AS modality, score, truth FROM scored WHERE score IS NOT NULL), g AS (SELECT DISTINCT method AS modality FROM scored),
own AS (SELECT DISTINCT modality, round(score, 4) AS threshold FROM s), th AS (SELECT modality, i / 20.0::DOUBLE AS threshold FROM g, (SELECT unnest(range(0, 21)) AS i) UNION SELECT modality, threshold FROM own WHERE modality IN (SELECT modality FROM own GROUP BY modality HAVING count(*) >= 3)),
curve AS (SELECT t.modality, threshold, count(*) FILTER (WHERE truth AND score >= threshold) AS tp, count(*) FILTER (WHERE NOT truth AND score >= threshold) AS fp, count(*) FILTER (WHERE truth AND score < threshold) AS fn, count(*) FILTER (WHERE NOT truth AND score < threshold) AS tn FROM th t JOIN s ON s.modality = t.modality GROUP BY t.modality, threshold),
rates AS (SELECT *, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, tp / nullif(tp + fp, 0) AS precision FROM curve)"""


@query(f"{_CURVE} SELECT modality, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn FROM rates")
def threshold_curves(spark, d):
    return calibration.threshold_curve(_samples(spark, d), ["modality"]).select("modality", "threshold", "tp", "fp", "fn", "tn")


@query(f"""{_CURVE}, f AS (SELECT *, CASE WHEN precision + tpr > 0 THEN 2 * precision * tpr / (precision + tpr) ELSE 0 END AS f1, coalesce(nullif(fpr, 0), 1) AS odd FROM rates),
a AS (SELECT modality, CASE WHEN fpr <= 0.2 THEN 'max_tpr_at_fpr_le_0.20' ELSE 'fallback_min_fpr' END AS rule, threshold, row_number() OVER (PARTITION BY modality ORDER BY (fpr <= 0.2) DESC, CASE WHEN fpr <= 0.2 THEN tpr ELSE -fpr END DESC, CASE WHEN fpr <= 0.2 THEN odd ELSE -tpr END, threshold) AS n FROM f),
b AS (SELECT modality, 'max_f1' AS rule, threshold, row_number() OVER (PARTITION BY modality ORDER BY f1 DESC, threshold) AS n FROM f), c AS (SELECT modality, 'youden' AS rule, threshold, row_number() OVER (PARTITION BY modality ORDER BY tpr - odd DESC, threshold) AS n FROM f)
SELECT modality, rule, threshold FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE n = 1""")
def threshold_selection(spark, d):
    curve = calibration.threshold_curve(_samples(spark, d), ["modality"])
    return calibration.select_thresholds(curve, ["modality"]).select("modality", "rule", "threshold")


_OPERATING = f"""WITH {fx.SCORED}, e AS (SELECT s.*, dur FROM scored s, (VALUES (1), (2), (3), (5), (10), (15), (30)) t(dur) WHERE length_s >= dur AND NOT (method LIKE 'V-%' AND truth AND severity = 'harsh')),
th AS (SELECT DISTINCT method, dur, x FROM (SELECT method, dur, score AS x FROM e WHERE score IS NOT NULL UNION ALL SELECT method, dur, -0.000001 FROM e UNION ALL SELECT method, dur, 1.000001 FROM e)),
j AS (SELECT t.x, e.*, row_status = 'evaluated' AND status = 'evaluated' AND score IS NOT NULL AND coalesce(observed_duration_s, length_s) >= t.dur AND score >= t.x AS live, coalesce(margin < 0.05, false) AS close FROM th t JOIN e ON e.method = t.method AND e.dur = t.dur),
c AS (SELECT method, dur AS minimum_duration_s, x AS threshold, count(*) FILTER (WHERE live AND NOT close AND truth AND top_parent = expected_parent)::BIGINT AS tp_correct_parent, count(*) FILTER (WHERE live AND NOT close AND NOT truth)::BIGINT AS fp, count(*) FILTER (WHERE live AND NOT close AND truth AND top_parent <> expected_parent)::BIGINT AS wrong_parent, count(*) FILTER (WHERE live AND close)::BIGINT AS ambiguous, count(*) FILTER (WHERE truth)::BIGINT AS positive_denominator, count(*) FILTER (WHERE NOT truth AND status = 'evaluated')::BIGINT AS negative_available_denominator, count(*) FILTER (WHERE NOT truth)::BIGINT AS negative_expected_denominator FROM j GROUP BY method, dur, x)"""


@query(f"{_OPERATING} SELECT * REPLACE (minimum_duration_s::BIGINT AS minimum_duration_s), round(tp_correct_parent / nullif(positive_denominator, 0), 6) AS tpr, round(fp / nullif(negative_available_denominator, 0), 6) AS fpr FROM c")
def operating_curves(spark, d):
    return calibration.operating_curve(fx.scored(spark, d)).withColumns({"tpr": F.round("tpr", 6), "fpr": F.round("fpr", 6), "minimum_duration_s": F.col("minimum_duration_s").cast("bigint")})


_EASY = _OPERATING.replace(fx.SCORED, fx.SEPARABLE).replace("FROM scored s,", "FROM easy s,")


@query(f"{_EASY}, q AS (SELECT *, tp_correct_parent / nullif(positive_denominator, 0) AS tpr, fp / nullif(negative_available_denominator, 0) AS fpr FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY minimum_duration_s, tpr DESC, fpr, threshold DESC) AS n FROM q WHERE minimum_duration_s >= 5 AND negative_available_denominator = negative_expected_denominator AND CASE WHEN method LIKE 'V-%' THEN tpr >= 0.7 AND fpr <= 0.02 ELSE tpr >= 0.75 AND fpr <= 0.015 END) SELECT method, minimum_duration_s::BIGINT AS minimum_duration_s, threshold, tp_correct_parent, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM k WHERE n = 1")
def operating_point_choice(spark, d):
    points = calibration.operating_points(calibration.operating_curve(fx.separable(spark, d)))
    return points.select("method", F.col("minimum_duration_s").cast("bigint"), "threshold", "tp_correct_parent", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"{_EASY}, q AS (SELECT *, tp_correct_parent / nullif(positive_denominator, 0) AS tpr, fp / nullif(negative_available_denominator, 0) AS fpr FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY minimum_duration_s, tpr DESC, fpr, threshold DESC) AS n FROM q WHERE minimum_duration_s >= 5 AND negative_available_denominator = negative_expected_denominator AND tpr >= 0.7 AND fpr <= 0.02 AND method LIKE 'V-%') SELECT method, threshold, minimum_duration_s::BIGINT AS minimum_duration_s, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM k WHERE n = 1 ORDER BY tpr DESC, fpr, method LIMIT 1")
def method_choice(spark, d):
    chosen = calibration.chosen_method(calibration.operating_points(calibration.operating_curve(fx.separable(spark, d))))
    return chosen.select("method", "threshold", F.col("minimum_duration_s").cast("bigint"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


_POINTED = ", q AS (SELECT *, tp_correct_parent / nullif(positive_denominator, 0) AS tpr, fp / nullif(negative_available_denominator, 0) AS fpr FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY minimum_duration_s, tpr DESC, fpr, threshold DESC) AS n FROM q WHERE minimum_duration_s >= 5 AND negative_available_denominator = negative_expected_denominator AND CASE WHEN method LIKE 'V-%' THEN tpr >= 0.7 AND fpr <= 0.02 ELSE tpr >= 0.75 AND fpr <= 0.015 END)"
_BOTH = _OPERATING.replace(fx.SCORED, fx.FUSABLE).replace("FROM scored s,", "FROM fusable s,") + _POINTED
#: Fusion of the visual and the audio method, at the duration that both qualify at; nothing unless both have a point.
_TRIALS = f"""WITH {fx.FUSABLE}, dur AS (SELECT max(minimum_duration_s) AS d, count(*) AS n FROM ({_BOTH} SELECT * FROM k WHERE n = 1)),
p AS (SELECT candidate_id AS c, left(method, 1) AS k, CASE i WHEN 1 THEN top_parent ELSE identity || '-' || i END AS parent, score / i AS score FROM fusable, (VALUES (1), (2)) t(i)),
f AS (SELECT w, v.c, v.parent, w * v.score + (1 - w) * a.score AS score FROM p v JOIN p a ON a.c = v.c AND a.parent = v.parent AND v.k = 'V' AND a.k = 'A', (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(w)),
r AS (SELECT *, score - lead(score) OVER o AS margin, row_number() OVER o AS n FROM f WINDOW o AS (PARTITION BY w, c ORDER BY score DESC, parent)),
e AS (SELECT r.w, b.identity, r.score AS x, coalesce(r.margin < 0.05, false) AS close, b.visual_ancestry OR b.audio_ancestry AS t, r.parent = b.expected_parent AS good, coalesce(observed_duration_s, length_s) >= (SELECT d FROM dur) AS long FROM fusable b JOIN r ON r.c = b.candidate_id AND r.n = 1 WHERE b.method = 'V-C' AND b.length_s >= (SELECT d FROM dur) AND (SELECT n FROM dur) = 2),
h AS (SELECT DISTINCT identity AS held FROM e UNION ALL SELECT NULL),
th AS (SELECT DISTINCT w, held, x FROM e JOIN h ON held IS NULL OR held <> identity UNION SELECT w, held, y FROM (SELECT DISTINCT w FROM e), h, (VALUES (-0.000001::DOUBLE), (1.000001::DOUBLE)) y(y)),
k AS (SELECT th.w, th.held, th.x, count(*) FILTER (WHERE e.x >= th.x AND long AND NOT close AND t AND good) AS tp, count(*) FILTER (WHERE e.x >= th.x AND long AND NOT close AND NOT t) AS fp, count(*) FILTER (WHERE t) AS np, count(*) FILTER (WHERE NOT t) AS nn FROM th JOIN e ON e.w = th.w AND (th.held IS NULL OR e.identity <> th.held) GROUP BY ALL),
fit AS (SELECT *, tp / np AS tpr, fp / nn AS fpr, row_number() OVER (PARTITION BY w, held ORDER BY tp / np DESC, fp / nn, x DESC) AS n FROM k WHERE tp / np >= 0.7 AND fp / nn <= 0.015),
o AS (SELECT e.w, count(*) FILTER (WHERE coalesce(e.x >= fit.x, false) AND long AND NOT close AND t AND good) AS tp, count(*) FILTER (WHERE t) AS np, count(*) FILTER (WHERE coalesce(e.x >= fit.x, false) AND long AND NOT close AND NOT t) AS fp, count(*) FILTER (WHERE NOT t) AS nn FROM e LEFT JOIN fit ON fit.w = e.w AND fit.held = e.identity AND fit.n = 1 GROUP BY e.w)
SELECT o.w AS weight, o.tp::BIGINT AS held_out_tp, o.np::BIGINT AS held_out_positive, o.fp::BIGINT AS held_out_fp, o.nn::BIGINT AS held_out_negative, round(fit.x, 6) AS full_threshold, round(fit.tpr, 6) AS full_tpr, round(fit.fpr, 6) AS full_fpr, fit.x IS NOT NULL AND o.tp / o.np >= 0.7 AND o.fp / o.nn <= 0.015 AS qualified FROM o LEFT JOIN fit ON fit.w = o.w AND fit.held IS NULL AND fit.n = 1"""


def _trials(spark, d):
    """Fusion of the visual and the audio method's scores of the parents that both verified. Refused, so empty, unless both
    have an operating point."""
    rows = fx.fusable(spark, d)
    chosen = calibration.fusion_constituents(calibration.operating_points(calibration.operating_curve(rows)), visual=("V-C",))
    visual, audio, duration = chosen or ("V-C", "A-chromaprint", 5)
    parents = F.array(F.struct(F.col("top_parent").alias("parent"), F.col("score").alias("score")), F.struct(F.concat("identity", F.lit("-2")).alias("parent"), (F.col("score") / 2).alias("score")))
    of = lambda method: rows.where(F.col("method") == method)
    pairs = lambda method: of(method).select(F.col("candidate_id").alias("candidate"), F.inline(parents))
    fused = calibration.fused_rows(of(visual), pairs(visual), pairs(audio))
    trials = calibration.held_out_fusion(fused, duration)
    return trials if chosen else trials.where("false")


@query(_TRIALS)
def held_out_fusion(spark, d):
    return _trials(spark, d).withColumns({c: F.round(c, 6) for c in ("full_threshold", "full_tpr", "full_fpr")})


@query(f"SELECT weight, round(held_out_tp / held_out_positive, 6) AS tpr, round(held_out_fp / held_out_negative, 6) AS fpr, full_threshold FROM ({_TRIALS}) WHERE qualified ORDER BY held_out_tp / held_out_positive DESC, held_out_fp / held_out_negative, weight LIMIT 1")
def fusion_choice(spark, d):
    c = calibration.chosen_fusion(_trials(spark, d))
    return c.select("weight", F.round(F.col("held_out_tp") / F.col("held_out_positive"), 6).alias("tpr"), F.round(F.col("held_out_fp") / F.col("held_out_negative"), 6).alias("fpr"), F.round("full_threshold", 6).alias("full_threshold"))


@query(f"""{_CURVE}, f AS (SELECT *, coalesce(nullif(fpr, 0), 1) AS odd FROM rates), k AS (SELECT modality, CASE WHEN fpr <= 0.2 THEN 'max_tpr_at_fpr_le_0.20' ELSE 'fallback_min_fpr' END AS selection_rule, threshold, row_number() OVER (PARTITION BY modality ORDER BY (fpr <= 0.2) DESC, CASE WHEN fpr <= 0.2 THEN tpr ELSE -fpr END DESC, CASE WHEN fpr <= 0.2 THEN odd ELSE -tpr END, threshold) AS n FROM f),
o AS (SELECT modality, list_sort(list(score) FILTER (WHERE truth)) AS p, list_sort(list(score) FILTER (WHERE NOT truth)) AS q FROM s GROUP BY modality)
SELECT o.modality, threshold, selection_rule, len(p)::BIGINT AS n_positive, len(q)::BIGINT AS n_negative, CASE WHEN p[len(p) // 2 + 1] <= q[len(q) // 2 + 1] THEN 'inverted_or_collapsed' WHEN len(list_filter(q, lambda x: x >= p[len(p) // 2 + 1])) / len(q) > 0.4 THEN 'high_overlap' WHEN len(list_filter(q, lambda x: x >= p[len(p) // 2 + 1])) / len(q) > 0.15 THEN 'moderate_overlap' ELSE 'low_overlap' END AS overlap_hint, k.threshold IS NOT NULL AND len(p) > 0 AND len(q) > 0 AS usable FROM o JOIN k ON k.modality = o.modality AND k.n = 1
UNION ALL SELECT 'positives', 0.0, 'fallback_min_fpr', count(*), 0, 'insufficient_data', false FROM scored WHERE method = 'V-C' AND truth AND score IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'unscored', NULL, NULL, 0, 0, 'insufficient_data', false FROM scored WHERE method = 'V-C' HAVING count(*) > 0""")
def threshold_profile(spark, d):
    """The methods, one of them again with its positives only, and again without scores: what lacks data is not usable."""
    s = _samples(spark, d)
    one = s.where("modality = 'V-C'")
    s = s.unionByName(one.where("is_positive").withColumn("modality", F.lit("positives"))).unionByName(one.withColumns({"modality": F.lit("unscored"), "score": F.lit(None).cast("double")}))
    return calibration.threshold_profile(s).select("modality", "threshold", "selection_rule", "n_positive", "n_negative", "overlap_hint", "usable")


_RANKED = "ranking AS (SELECT candidate_id, method, CASE WHEN i = 1 + candidate_id % 7 THEN identity ELSE identity || '-' || i END AS parent, i AS rank FROM scored, (SELECT unnest(range(1, 11)) AS i) WHERE score IS NOT NULL)"
_SUMMARY = """s AS (SELECT method, count(*) AS n_expected, count(*) FILTER (WHERE truth) AS positive_expected, count(*) FILTER (WHERE NOT truth) AS negative_expected, count(*) FILTER (WHERE processing = 'evaluated') AS n_evaluated, count(*) FILTER (WHERE state = 'AMBIGUOUS') AS ambiguous,
  count(*) FILTER (WHERE truth AND parent = expected_parent) AS correct_parent, count(*) FILTER (WHERE truth AND parent <> expected_parent) AS wrong_parent, count(*) FILTER (WHERE truth AND state = 'AMBIGUOUS') AS ambiguous_parent, count(*) FILTER (WHERE truth AND processing <> 'evaluated') AS unavailable_positive, count(*) FILTER (WHERE NOT truth AND processing <> 'evaluated') AS unavailable_negative,
  count(*) FILTER (WHERE truth AND processing = 'evaluated' AND state = 'supported') AS tp, count(*) FILTER (WHERE NOT truth AND processing = 'evaluated' AND state = 'supported') AS fp, count(*) FILTER (WHERE NOT truth AND processing = 'evaluated' AND state <> 'supported') AS tn, count(*) FILTER (WHERE truth AND processing = 'evaluated' AND state <> 'supported') AS fn, avg(margin) AS mean_margin FROM states GROUP BY method)"""
_COUNTS = ("n_expected", "positive_expected", "negative_expected", "n_evaluated", "ambiguous", "correct_parent", "wrong_parent", "ambiguous_parent", "unavailable_positive", "unavailable_negative", "tp", "fp", "tn", "fn")
_RATES = ("tpr", "fpr", "precision", "f1", "tpr_lower_bound", "mean_margin", "recall_at_1", "recall_at_5", "recall_at_10")


def _ranking(spark, d):
    at = F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")
    named = F.when(F.col("rank") == 1 + F.col("candidate_id") % 7, F.col("identity")).otherwise(F.concat_ws("-", "identity", F.col("rank").cast("string")))
    return fx.scored(spark, d).where("score IS NOT NULL").select("candidate_id", "method", "identity", at).select("candidate_id", "method", named.alias("parent"), "rank")


@query(f"WITH {fx.DECIDED}, {_RANKED}, {_SUMMARY}, w AS (SELECT x.method, x.candidate_id, min(ranking.rank) AS rank FROM scored x LEFT JOIN ranking ON ranking.candidate_id = x.candidate_id AND ranking.method = x.method AND ranking.parent = x.expected_parent WHERE x.truth GROUP BY ALL), k AS (SELECT method, avg(coalesce(rank <= 1, false)::INT) AS r1, avg(coalesce(rank <= 5, false)::INT) AS r5, avg(coalesce(rank <= 10, false)::INT) AS r10 FROM w GROUP BY method) SELECT s.method, {', '.join(f's.{c}::BIGINT AS {c}' for c in _COUNTS)}, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / positive_expected, 6) AS tpr_lower_bound, round(mean_margin, 6) AS mean_margin, round(r1, 6) AS recall_at_1, round(r5, 6) AS recall_at_5, round(r10, 6) AS recall_at_10 FROM s JOIN k ON k.method = s.method")
def method_summary(spark, d):
    decided = _decided(spark, d)
    out = accounting.summary(decided, ["method"]).join(accounting.with_recall(decided, _ranking(spark, d), ["method"]), "method", "left")
    return out.select("method", *_COUNTS, *[F.round(c, 6).alias(c) for c in _RATES])


@query("SELECT * FROM (VALUES (0::BIGINT, 10::BIGINT, 0.0::DOUBLE, 0.308497::DOUBLE), (5, 10, 0.187086, 0.812914), (10, 10, 0.691503, 1.0), (1, 20, 0.001265, 0.248733), (0, 0, NULL, NULL)) t(k, n, low, high)")
def binomial_fixed_points(spark, d):
    rows = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (1, 20), (0, 0)], "k bigint, n bigint").withColumn("i", binomial_interval_column(F.col("k"), F.col("n")))
    return rows.select("k", "n", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


_HALVED = "list_reduce(list_prepend([0.0::DOUBLE, 1.0::DOUBLE], list_transform(range(64), lambda i: [0.0::DOUBLE, 1.0::DOUBLE])), lambda a, b: CASE WHEN {test} THEN [(a[1] + a[2]) / 2, a[2]] ELSE [a[1], (a[1] + a[2]) / 2] END)[1]"
_TAIL = "list_sum(list_transform(range({a}, {b}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a[1] + a[2]) / 2) + (n - i) * ln(1 - (a[1] + a[2]) / 2))))"
_LOW = _HALVED.format(test=_TAIL.format(a="k", b="n + 1") + " < 0.025")
_HIGH = _HALVED.format(test=_TAIL.format(a="0", b="k + 1") + " > 0.025")


@query(f"WITH {fx.DECIDED}, {_SUMMARY}, c AS (SELECT method, tp::BIGINT AS k, (tp + fn)::BIGINT AS n FROM s) SELECT method, round(CASE WHEN k = 0 THEN 0 ELSE {_LOW} END, 9) AS low, round(CASE WHEN k = n THEN 1 ELSE {_HIGH} END, 9) AS high FROM c")
def binomial_intervals(spark, d):
    s = accounting.summary(_decided(spark, d), ["method"]).withColumn("i", binomial_interval_column(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.select("method", F.round("i.low", 9).alias("low"), F.round("i.high", 9).alias("high"))


@query(f"WITH {fx.DECIDED}, x AS (SELECT method, identity, bool_or(state = 'supported') AS y FROM states WHERE NOT truth AND processing = 'evaluated' GROUP BY method, identity) SELECT method, count(*)::BIGINT AS n_identities, count(*) FILTER (WHERE y)::BIGINT AS n_with_fp FROM x GROUP BY method")
def identity_false_positives(spark, d):
    return accounting.identity_false_positives(_decided(spark, d), ["method"])


@query(f"WITH {fx.DECIDED}, b AS (SELECT method, 'total' AS dimension, '' AS value, * EXCLUDE (method) FROM states UNION ALL SELECT method, 'transform', transform, * EXCLUDE (method) FROM states UNION ALL SELECT method, 'length_s', length_s::VARCHAR, * EXCLUDE (method) FROM states UNION ALL SELECT method, 'severity', severity, * EXCLUDE (method) FROM states) SELECT method, dimension, value, count(*)::BIGINT AS n, count(*) FILTER (WHERE truth AND processing = 'evaluated' AND state = 'supported')::BIGINT AS tp, count(*) FILTER (WHERE NOT truth AND processing = 'evaluated' AND state = 'supported')::BIGINT AS fp, count(*) FILTER (WHERE NOT truth AND processing = 'evaluated' AND state <> 'supported')::BIGINT AS tn, count(*) FILTER (WHERE truth AND processing = 'evaluated' AND state <> 'supported')::BIGINT AS fn FROM b GROUP BY ALL")
def breakdowns(spark, d):
    return accounting.breakdown(_decided(spark, d), ["transform", "length_s", "severity"], ["method"])


@query(f"WITH {fx.DECIDED} SELECT identity, parent, count(*)::BIGINT AS n FROM states WHERE NOT truth AND state = 'supported' GROUP BY identity, parent")
def false_positive_concentration(spark, d):
    return accounting.false_positive_concentration(_decided(spark, d))


@query(f"WITH {fx.SCORED} SELECT method, status, count(*)::BIGINT AS n FROM scored GROUP BY method, status")
def status_reconciliation(spark, d):
    return accounting.by_status(fx.scored(spark, d), ["method"])


def _claims(spark, d):
    x = fx.table(spark, d, "documents").select("doc_id").withColumn("k", F.col("doc_id") % 10)
    pair = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    k = F.col("k")
    claimed = F.when(F.col("doc_id") % 11 == 0, iv.empty()).otherwise(F.array(pair(k + 20, k + 26), pair(k, k + 8), pair(k + 5, k + 9)))
    truth = F.when(F.col("doc_id") % 3 == 0, F.array(pair(F.lit(2), F.lit(12)), pair(F.lit(20), F.lit(30)))).otherwise(F.array(pair(F.lit(4), F.lit(16))))
    return x.select("doc_id", claimed.alias("claimed"), truth.alias("truth"), (F.col("doc_id") % 7 != 0).alias("right_parent")).withColumns({"n_claimed": F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2), "n_truth": F.size("truth")})


_CLAIMS = """WITH x AS (SELECT doc_id, doc_id % 10 AS k FROM documents), c AS (SELECT doc_id, unnest(CASE WHEN doc_id % 11 = 0 THEN [] ELSE [[k + 20, k + 26], [k, k + 8], [k + 5, k + 9]] END) AS i FROM x),
t AS (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN [[2, 12], [20, 30]] ELSE [[4, 16]] END) AS i FROM x),
cs AS (SELECT DISTINCT doc_id, unnest(range(i[1], i[2])) AS s FROM c), ts AS (SELECT DISTINCT doc_id, unnest(range(i[1], i[2])) AS s FROM t),
u AS (SELECT doc_id, count(*) FILTER (WHERE a AND b) AS both_, count(*) AS any_ FROM (SELECT coalesce(cs.doc_id, ts.doc_id) AS doc_id, cs.s IS NOT NULL AS a, ts.s IS NOT NULL AS b FROM cs FULL JOIN ts ON cs.doc_id = ts.doc_id AND cs.s = ts.s) GROUP BY doc_id),
ce AS (SELECT doc_id, min(i[1]) AS lo, max(i[2]) AS hi, sum(i[2] - i[1]) AS len FROM c GROUP BY doc_id), te AS (SELECT doc_id, min(i[1]) AS lo, max(i[2]) AS hi, sum(i[2] - i[1]) AS len FROM t GROUP BY doc_id),
r AS (SELECT x.doc_id, ce.doc_id IS NOT NULL AND x.doc_id % 7 <> 0 AS valid, both_ / any_ AS iou, abs(ce.lo - te.lo) AS se, abs(ce.hi - te.hi) AS ee, ce.len / te.len AS pad, x.doc_id % 3 = 0 AS several, x.doc_id % 2 = 0 AS one FROM x JOIN u USING (doc_id) LEFT JOIN ce USING (doc_id) JOIN te USING (doc_id))"""


@query(f"{_CLAIMS} SELECT doc_id, round(CASE WHEN valid THEN iou ELSE 0 END, 6) AS iou, (CASE WHEN valid THEN se END)::DOUBLE AS start_error, (CASE WHEN valid THEN ee END)::DOUBLE AS end_error, round(CASE WHEN valid THEN pad END, 6) AS padding, CASE WHEN several THEN valid AND one END AS false_continuous FROM r")
def temporal_rows(spark, d):
    return accounting.temporal_rows(_claims(spark, d)).select("doc_id", F.round("iou", 6).alias("iou"), "start_error", "end_error", F.round("padding", 6).alias("padding"), "false_continuous")


_TEMPORAL = f"""{_CLAIMS}, q AS (SELECT doc_id % 3 AS g, doc_id % 5 <> 0 AS issued, * FROM r),
al AS (SELECT g, avg(CASE WHEN valid THEN iou ELSE 0 END) AS iou, avg(valid::INT) AS cov FROM q GROUP BY g),
is_ AS (SELECT g, avg(CASE WHEN valid THEN se END) AS se, avg(CASE WHEN valid THEN ee END) AS ee, count(*) FILTER (WHERE several) AS k, count(*) FILTER (WHERE several AND valid AND one) AS f FROM q WHERE issued GROUP BY g),
v AS (SELECT al.g, round(iou, 6) AS mean_iou, round(cov, 6) AS coverage, round(se, 6) AS mean_start_error, round(ee, 6) AS mean_end_error, k::BIGINT AS n_several, f::BIGINT AS n_false_continuous, CASE WHEN f / nullif(k, 0) > 0.2 THEN 'NO-GO' WHEN iou >= 0.7 AND se <= 1 AND ee <= 1 AND f / nullif(k, 0) <= 0.05 AND cov >= 0.7 THEN 'GO' ELSE 'CAUTION' END AS verdict FROM al JOIN is_ ON is_.g = al.g)"""


@query(f"{_TEMPORAL} SELECT g::BIGINT AS g, mean_iou, coverage, mean_start_error, mean_end_error, n_several, n_false_continuous, verdict FROM v")
def temporal_verdict(spark, d):
    rows = accounting.temporal_rows(_claims(spark, d)).withColumn("g", F.col("doc_id") % 3)
    s = accounting.alignment_verdict(accounting.temporal_verdict_input(rows, ["g"], F.col("doc_id") % 5 != 0))
    named = {"all_mean_iou": "mean_iou", "all_coverage": "coverage", "issued_mean_start_error": "mean_start_error", "issued_mean_end_error": "mean_end_error"}
    return s.select(F.col("g").cast("bigint"), *[F.round(c, 6).alias(n) for c, n in named.items()], F.col("issued_n_several").alias("n_several"), F.col("issued_n_false_continuous").alias("n_false_continuous"), "verdict")


_VERDICTS = f"""WITH {fx.FUSABLE}, has AS ({_BOTH} SELECT method FROM k WHERE n = 1), th AS (SELECT unnest([0.3, 0.5, 0.56, 0.8]::DOUBLE[]) AS t),
dec AS (SELECT f.*, th.t, CASE WHEN coalesce(observed_duration_s, length_s) < {fx.MINIMUM} OR score < th.t THEN 'insufficient' WHEN margin < 0.05 THEN 'AMBIGUOUS' ELSE 'supported' END AS state FROM fusable f, th),
m AS (SELECT t, method, count(*) FILTER (WHERE truth AND state = 'supported' AND top_parent = expected_parent) / nullif(count(*) FILTER (WHERE truth), 0) AS c, count(*) FILTER (WHERE NOT truth AND state = 'supported') / nullif(count(*) FILTER (WHERE NOT truth), 0) AS f FROM dec WHERE length_s >= 5 AND NOT (method LIKE 'V-%' AND truth AND severity = 'harsh') GROUP BY t, method),
mv AS (SELECT t, coalesce(bool_or(c >= 0.7 AND f <= 0.02 AND method IN (SELECT method FROM has)) FILTER (WHERE method = 'V-C'), false) AS v, coalesce(bool_or(c >= 0.75 AND f <= 0.015 AND method IN (SELECT method FROM has)) FILTER (WHERE method = 'A-chromaprint'), false) AS a FROM m GROUP BY t),
rt AS (SELECT v.t, v.visual_ancestry AS va, v.audio_ancestry AS aa, v.state = 'supported' AS vs, a.state = 'supported' AS sa FROM dec v JOIN dec a ON a.candidate_id = v.candidate_id AND a.t = v.t AND v.method = 'V-C' AND a.method = 'A-chromaprint'),
x AS (SELECT t, count(*) FILTER (WHERE va AND vs) / nullif(count(*) FILTER (WHERE va), 0) AS vtp, count(*) FILTER (WHERE aa AND sa) / nullif(count(*) FILTER (WHERE aa), 0) AS atp, count(*) FILTER (WHERE (va OR aa) AND (vs OR sa)) / nullif(count(*) FILTER (WHERE va OR aa), 0) AS otp, count(*) FILTER (WHERE NOT (va OR aa) AND (vs OR sa)) / nullif(count(*) FILTER (WHERE NOT (va OR aa)), 0) AS ofp FROM rt GROUP BY t),
al AS (SELECT g, verdict AS alignment FROM ({_TEMPORAL} SELECT g, verdict FROM v))"""


@query(f"{_VERDICTS} SELECT g::BIGINT AS g, mv.t AS threshold, alignment, CASE WHEN mv.v THEN 'GO' ELSE 'NO-GO' END AS visual, CASE WHEN mv.a THEN 'GO' ELSE 'NO-GO' END AS audio, round(otp, 6) AS either_tpr, round(greatest(vtp, atp), 6) AS single_tpr, round(ofp, 6) AS either_fpr, CASE WHEN (NOT mv.v AND NOT mv.a) OR alignment = 'NO-GO' THEN 'CORE NO-GO' WHEN alignment = 'GO' AND mv.v AND mv.a AND otp > greatest(vtp, atp) AND coalesce(ofp, 0) <= 0.02 THEN 'STRONG GO' WHEN alignment = 'GO' AND (mv.v OR mv.a) THEN 'CORE GO' ELSE 'CAUTION' END AS overall FROM mv JOIN x ON x.t = mv.t, al")
def overall_verdict(spark, d):
    """The verdict at each of four thresholds: by the operating points that calibration finds, the modalities' rates and
    routing at the threshold, and the alignment verdict of each of the temporal groups."""
    rows = fx.fusable(spark, d)
    points = calibration.operating_points(calibration.operating_curve(rows)).select("method", F.lit(True).alias("has_point"))
    decided = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.56, 0.8))))).withColumn("decision", decisions.decision(F.col("threshold"), F.lit(fx.MINIMUM)))
    subset = decided.where(F.col("length_s") >= 5).where(~(F.col("method").startswith("V-") & F.col("truth") & (F.col("severity") == "harsh")))
    rates = accounting.summary(subset, ["threshold", "method"]).join(points, "method", "left").select("threshold", "method", F.coalesce("has_point", F.lit(False)).alias("has_point"), F.try_divide("correct_parent", "positive_expected").alias("correct_parent_rate"), "fpr")
    modal = accounting.modality_verdict(rates, calibration.GATES, by=["threshold"]).groupBy("threshold").agg(*[F.max(F.when(F.col("modality") == m, F.col("verdict"))).alias(m) for m in ("visual", "audio")])
    v = decided.where("method = 'V-C'").select("threshold", "candidate_id", "visual_ancestry", "audio_ancestry", F.col("decision").alias("v"))
    a = decided.where("method = 'A-chromaprint'").select("threshold", "candidate_id", F.col("decision").alias("a"))
    routed = v.join(a, ["threshold", "candidate_id"]).select("threshold", "candidate_id", "visual_ancestry", "audio_ancestry", *decisions.route(F.col("v"), F.col("a")))
    of = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    modes = accounting.multimodal(routed, ["threshold"]).groupBy("threshold").agg(of("visual_or_audio", "tpr").alias("either_tpr"), F.greatest(of("visual_only", "tpr"), of("audio_only", "tpr")).alias("single_tpr"), of("visual_or_audio", "fpr").alias("either_fpr"))
    one = modal.join(modes, "threshold").crossJoin(temporal_verdict(spark, d).select("g", F.col("verdict").alias("alignment")))  # a few rows each
    verdict = accounting.overall_verdict(*[F.col(c) for c in ("visual", "audio", "alignment", "either_tpr", "single_tpr", "either_fpr")])
    return one.select("g", "threshold", "alignment", "visual", "audio", *[F.round(c, 6).alias(c) for c in ("either_tpr", "single_tpr", "either_fpr")], verdict.alias("overall"))


_FIRST = f"""WITH {fx.SCORED}, w AS (SELECT v.candidate_id AS id, v.row_status, v.visual_ancestry AS va, v.audio_ancestry AS aa, v.score AS vs, a.score AS sa, v.top_parent, v.expected_parent, v.margin FROM scored v JOIN scored a ON a.candidate_id = v.candidate_id AND v.method = 'V-C' AND a.method = 'A-chromaprint'),
x AS (SELECT *, row_status = 'evaluated' AS ready, CASE WHEN margin < 0.08 THEN 'AMBIGUOUS' ELSE 'ranked' END AS disposition, id % 2 = 0 AS here, id % 3 <> 0 AS der FROM w)"""


@query(f"""{_FIRST}, c AS (SELECT count(*) FILTER (WHERE ready AND here AND vs IS NOT NULL) AS vn, count(*) FILTER (WHERE ready AND here AND der AND va AND vs >= 0.6) AS vtp, count(*) FILTER (WHERE ready AND here AND NOT (der AND va) AND vs >= 0.6) AS vfp, count(*) FILTER (WHERE ready AND here AND NOT (der AND va) AND vs < 0.6) AS vtn, count(*) FILTER (WHERE ready AND here AND der AND va AND vs < 0.6) AS vfn,
count(*) FILTER (WHERE ready AND here AND der AND aa AND sa >= 0.7) AS atp, count(*) FILTER (WHERE ready AND here AND NOT (der AND aa) AND sa >= 0.7) AS afp, count(*) FILTER (WHERE NOT ready) AS failed, count(*) FILTER (WHERE ready AND disposition = 'AMBIGUOUS') AS amb, count(*) FILTER (WHERE ready AND here AND der) AS nd, count(*) FILTER (WHERE ready AND here AND der AND top_parent = expected_parent) AS hit FROM x)
SELECT vn::BIGINT AS visual_n, vtp::BIGINT AS visual_tp, vfp::BIGINT AS visual_fp, vtn::BIGINT AS visual_tn, vfn::BIGINT AS visual_fn, round(vtp / (vtp + vfn), 6) AS visual_tpr, round(vfp / (vfp + vtn), 6) AS visual_fpr, round(vtp / (vtp + vfp), 6) AS visual_precision, round(2 * vtp / (2 * vtp + vfp + vfn), 6) AS visual_f1, atp::BIGINT AS audio_tp, afp::BIGINT AS audio_fp, failed::BIGINT AS n_failed_all_partitions, amb::BIGINT AS n_ambiguous_all_partitions, nd::BIGINT AS n_derivative, round(hit / nd, 6) AS recall_at_1, CASE WHEN (rate IS NULL AND rows = 0) OR vtp + vfn < 3 THEN 'CAUTION' ELSE 'PASS' END AS harness FROM c, (SELECT rows, rate FROM ({_TEMPORAL} SELECT count(*) AS rows, count(*) FILTER (WHERE several AND valid AND one) / nullif(count(*) FILTER (WHERE several), 0) AS rate FROM q))""")
def first_evaluation(spark, d):
    s = fx.scored(spark, d)
    audio = s.where("method = 'A-chromaprint'").select("candidate_id", F.col("score").alias("audio_score"))
    v = s.where("method = 'V-C'").join(audio, "candidate_id")
    rows = v.select(
        F.when(F.col("row_status") == "evaluated", "ok").otherwise("failed").alias("row_status"), retrieval.disposition(F.col("margin"), F.lit(2)).alias("disposition"),
        F.when(F.col("candidate_id") % 2 == 0, "evaluation").otherwise("calibration").alias("partition"), (F.col("candidate_id") % 3 != 0).alias("is_derivative"),
        "visual_ancestry", "audio_ancestry", F.col("score").alias("visual_score"), "audio_score", "top_parent", F.col("expected_parent").alias("true_parent"),
    )
    out = accounting.first_evaluation(rows, F.lit(0.6), F.lit(0.7))
    # The harness: its temporal rows, and two runs over the same table.
    temporal = accounting.temporal_summary(accounting.temporal_rows(_claims(spark, d)), []).select(F.col("n").alias("n_temporal"), F.try_divide("n_false_continuous", "n_several").alias("false_continuous_rate"))
    run = s.where("method = 'V-C'").select("candidate_id", "status", F.sha2(F.concat_ws("|", "candidate_id", "score"), 256).alias("digest"), "score")
    again = run.withColumn("score", F.col("score") + F.when(F.col("candidate_id") % 50 == 0, 1e-9).otherwise(0.0))
    out = out.crossJoin(temporal).crossJoin(accounting.compare_runs(run, again, "candidate_id").select("reproducibility"))  # one row each
    harness = accounting.harness_verdict(F.col("n_temporal"), F.col("false_continuous_rate"), F.col("visual_tp") + F.col("visual_fn"), F.col("reproducibility"))
    whole = [f"visual_{k}" for k in ("n", "tp", "fp", "tn", "fn")]
    return out.select(*whole, *[F.round(f"visual_{k}", 6).alias(f"visual_{k}") for k in ("tpr", "fpr", "precision", "f1")], "audio_tp", "audio_fp", "n_failed_all_partitions", "n_ambiguous_all_partitions", "n_derivative", F.round("recall_at_1", 6).alias("recall_at_1"), harness.alias("harness"))


_SPANS = "e AS (SELECT event_id AS id, user_id, event_type, epoch_us(ts) // 60000000 AS a, epoch_us(ts) // 60000000 + 600 + (event_id % 7) * 100 AS b FROM events)"


def _spans(spark, d):
    minute = F.floor(F.col("us") / 60000000)
    return fx.event_rows(spark, d).select(F.col("event_id").alias("id"), "user_id", "event_type", minute.alias("a"), (minute + 600 + (F.col("event_id") % 7) * 100).alias("b"))


@query(f"WITH {_SPANS}, m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e), n AS (SELECT *, sum(CASE WHEN p IS NULL OR a - p > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m) SELECT user_id, min(a)::BIGINT AS a, max(b)::BIGINT AS b, count(*)::BIGINT AS n FROM n GROUP BY user_id, island")
def interval_merge(spark, d):
    return evidence.merged_intervals(_spans(spark, d), ["user_id"], 30).select("user_id", F.col("a").cast("bigint"), F.col("b").cast("bigint"), "n")


@query(f"WITH {_SPANS} SELECT l.user_id, count(*)::BIGINT AS n, sum(least(l.b, r.b) - greatest(l.a, r.a))::BIGINT AS shared FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'error' AND l.a < r.b AND r.a < l.b GROUP BY l.user_id")
def interval_join(spark, d):
    s = _spans(spark, d)
    pairs = evidence.interval_overlaps(s.where("event_type = 'purchase'"), s.where("event_type = 'error'"), ["user_id"], 1500)
    return pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("shared").cast("bigint").alias("shared"))


_BODY = "b AS (SELECT user_id AS log, list(body ORDER BY us, body) AS bodies FROM (SELECT user_id, epoch_us(ts) AS us, event_type || ':' || event_id AS body FROM events) GROUP BY user_id)"


def _chain(spark, d):
    e = fx.event_rows(spark, d).withColumn("body", F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    return evidence.build_chain(e, "user_id", "us", "body")


@query(f"WITH {_BODY} SELECT log, len(bodies)::BIGINT AS n_events, list_reduce(list_prepend('{evidence.GENESIS}', bodies), lambda a, x: sha256(a || chr(10) || x)) AS head FROM b")
def event_chain(spark, d):
    return _chain(spark, d).groupBy("log").agg(F.count("*").alias("n_events"), F.max_by("event_hash", "seq").alias("head"))


@query(f"WITH {_BODY} SELECT log, len(bodies)::BIGINT AS n_events, log % 3 <> 0 AS valid, CASE WHEN log % 3 = 0 THEN 2::BIGINT END AS first_bad_seq, CASE WHEN log % 3 = 0 THEN 'event_chain_mismatch' END AS reason FROM b WHERE len(bodies) > 2")
def chain_verification(spark, d):
    from ..functions.bits import chained

    chain = _chain(spark, d)
    heads = chain.groupBy("log").agg(F.count("*").alias("sequence"), F.max_by("event_hash", "seq").alias("head"))
    spoilt = chain.withColumn("body", chained([((F.col("seq") == 2) & (F.col("log") % 3 == 0), F.lit("forged"))], F.col("body")))
    return evidence.log_status(spoilt, heads).where("n_events > 2")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_row(spark, d):
    return evidence.latest(fx.table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("""WITH dv AS (SELECT doc_id AS child, sha256(text) AS sha, doc_id // 2 AS parent, doc_id AS auth FROM documents WHERE doc_id % 2 = 1), au AS (SELECT doc_id AS auth, doc_id // 2 AS parent, sha256(text) AS sha, doc_id % 50 AS f, doc_id % 50 + 20 AS u, CASE WHEN doc_id % 9 = 0 THEN 1 END AS revoked FROM documents WHERE doc_id % 3 <> 0)
SELECT dv.child, dv.parent AS parent_id, CASE WHEN au.revoked IS NULL AND au.auth IS NOT NULL AND 30 BETWEEN f AND u THEN dv.auth END AS authorization_id, CASE WHEN au.revoked IS NULL AND au.auth IS NOT NULL AND 30 BETWEEN f AND u THEN 'authorized' ELSE 'unauthorized' END AS state FROM dv JOIN documents a ON a.doc_id = dv.parent LEFT JOIN au ON au.auth = dv.auth AND au.parent = dv.parent AND au.sha = dv.sha""")
def lineage_validity(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    odd = docs.where("doc_id % 2 = 1")
    parent = F.floor(F.col("doc_id") / 2)
    children = odd.select(F.col("doc_id").alias("child"), F.concat_ws(":", "sha", "doc_id").alias("child_sha256"))
    derivatives = odd.select(F.concat_ws(":", "sha", "doc_id").alias("child_sha256"), parent.alias("parent_id"), F.col("doc_id").alias("authorization_id"))
    auth = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("authorization_id"), parent.alias("parent_id"), F.concat_ws(":", "sha", "doc_id").alias("child_sha256"), (F.col("doc_id") % 50).alias("valid_from"), (F.col("doc_id") % 50 + 20).alias("valid_until"))
    revoked = docs.where("doc_id % 9 = 0").select(F.col("doc_id").alias("authorization_id"), F.lit(1).alias("revoked_at"))
    assets = docs.select(F.col("doc_id").alias("id"))
    return evidence.lineage(children, derivatives, assets, evidence.without_revoked(auth, revoked), F.lit(30))


@query("WITH i AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'negative' ELSE 'source' END AS role, source || '-' || lang AS identity, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY identity) AS k, count(*) OVER (PARTITION BY role) AS m FROM i) SELECT role, identity, n::BIGINT AS n_assets, CASE WHEN k <= CASE WHEN m > 1 THEN least(greatest(1, floor(m * 0.5)), m - 1) ELSE 1 END THEN 'calibration' ELSE 'evaluation' END AS partition FROM r")
def identity_split(spark, d):
    a = fx.table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, "negative").otherwise("source").alias("role"), F.concat_ws("-", "source", "lang").alias("identity"))
    return partitioning.split_by_identity(a)


@query("WITH p AS (SELECT doc_id // 2 AS id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS part, source AS g, lang AS c FROM documents) SELECT 'duplicate_id' AS rule, id::VARCHAR AS key, count(*)::BIGINT AS n FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'group_spans_partitions', g, count(DISTINCT part)::BIGINT FROM p GROUP BY g HAVING count(DISTINCT part) > 1 UNION ALL SELECT 'component_spans_partitions', c, count(DISTINCT part)::BIGINT FROM p GROUP BY c HAVING count(DISTINCT part) > 1")
def leakage_checks(spark, d):
    p = fx.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("id"), F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("partition"), F.col("source").alias("identity_group"), F.col("lang").alias("component_id"))
    return partitioning.leaks(p)


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'unexpected' ELSE 'label_mismatch' END AS problem FROM documents WHERE doc_id % 10 <= 2")
def coverage_audit(spark, d):
    x = fx.table(spark, d, "documents").select("doc_id", "source", "lang")
    spoilt = x.where("doc_id % 10 <> 0").withColumn("lang", F.when(F.col("doc_id") % 10 == 2, "xx").otherwise(F.col("lang")))
    return partitioning.coverage(x.where("doc_id % 10 <> 1"), spoilt, "doc_id", ["source", "lang"])


@query("SELECT count(*) FILTER (WHERE doc_id % 10 = 0)::BIGINT AS only_first, count(*) FILTER (WHERE doc_id % 10 = 1)::BIGINT AS only_second, count(*) FILTER (WHERE doc_id % 10 > 1)::BIGINT AS shared, false AS equal FROM documents")
def set_equality(spark, d):
    x = fx.table(spark, d, "documents").select("doc_id")
    return partitioning.same_ids(x.where("doc_id % 10 <> 1"), x.where("doc_id % 10 <> 0"), "doc_id")


@query(f"WITH {fx.SCORED}, r AS (SELECT candidate_id AS id, status, score FROM scored WHERE method = 'V-C'), n AS (SELECT count(*) FILTER (WHERE id % 13 <> 0 AND id % 12 <> 0) AS s, count(*) FILTER (WHERE id % 13 = 0 AND id % 12 <> 0) AS a, count(*) FILTER (WHERE id % 12 = 0 AND id % 13 <> 0) AS b, count(*) FILTER (WHERE id % 13 <> 0 AND id % 12 <> 0 AND (id % 10 <> 0 OR score IS NULL)) AS e FROM r) SELECT s::BIGINT AS n_shared, a::BIGINT AS only_first, b::BIGINT AS only_second, s::BIGINT AS same_status, s::BIGINT AS same_digest, e::BIGINT AS same_score, e::BIGINT AS near_score, CASE WHEN e < s THEN 0.5::DOUBLE ELSE 0 END AS max_difference, CASE WHEN a + b > 0 OR e < s THEN 'UNSTABLE' ELSE 'BIT_DETERMINISTIC' END AS reproducibility FROM n")
def run_comparison(spark, d):
    r = fx.scored(spark, d).where("method = 'V-C'").select(F.col("candidate_id").alias("id"), "status", F.sha2(F.coalesce(F.col("score").cast("string"), F.lit("")), 256).alias("digest"), "score")
    other = r.where("id % 13 <> 0").withColumn("score", F.when(F.col("id") % 10 == 0, F.col("score") + 0.5).otherwise(F.col("score")))
    return accounting.compare_runs(r.where("id % 12 <> 0"), other, "id").withColumn("max_difference", F.round(F.coalesce("max_difference", F.lit(0.0)), 6))


@query("""WITH l AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3), (3, 5), (4, 10), (5, 15), (6, 30)) t(li, length_s)), r AS (SELECT string_split('h264_q18 h264_q42 mpeg4 scale720 scale480 scale360 crop10 crop40 crop60 offcenter25 mirror rotate5 rotate15 perspective letterbox speed075 speed150 reordered discontinuous frame_insert_delete logo central_text picture_in_picture reaction_layout audio_offset pitch_up2 music_overlay noise_compression silence_insertion screen_recording film_monitor upscale_lanczos frame_interpolation denoise', ' ') AS rot, string_split('trim h264_q35 crop25 speed125 audio_replace subtitles', ' ') AS anc),
s AS (SELECT 'S' || lpad(num::VARCHAR, 2, '0') AS identity, num, li, length_s, ti, CASE WHEN ti < 6 THEN anc[ti + 1] ELSE rot[(num * 7 + li * 6 + ti - 6) % 34 + 1] END AS transform FROM r, l, (SELECT unnest(range(1, 17)) AS num), (SELECT unnest(range(0, 12)) AS ti)),
a AS (SELECT (num - 1) * 84 + li * 12 + ti + 1 AS k, identity, length_s, transform, true AS v FROM s UNION ALL SELECT 1344 + (num - 1) * 7 + li + 1, 'N' || lpad(num::VARCHAR, 2, '0'), length_s, 'negative_excerpt', false FROM l, (SELECT unnest(range(1, 25)) AS num))
SELECT 'E' || lpad(k::VARCHAR, 5, '0') AS candidate_id, identity, length_s::BIGINT AS length_s, transform, v AS visual_ancestry, v AND transform <> 'audio_replace' AND NOT (transform = 'audio_offset' AND length_s <= 1.5) AS audio_ancestry, CASE WHEN regexp_matches(transform, '^(audio|pitch|music|noise|silence)') THEN 'AUDIO' WHEN regexp_matches(transform, '^(speed|reordered|discontinuous|frame_|trim)') AND transform <> 'frame_interpolation' THEN 'TEMPORAL' WHEN transform IN ('subtitles', 'logo', 'central_text', 'picture_in_picture', 'reaction_layout') THEN 'OVERLAY' WHEN transform IN ('screen_recording', 'film_monitor') THEN 'CAPTURE' WHEN transform IN ('upscale_lanczos', 'frame_interpolation', 'denoise') THEN 'AI_LIGHT' WHEN regexp_matches(transform, '^(h264|mpeg4|scale)') THEN 'TRANSCODING' ELSE 'GEOMETRY' END AS family,
CASE WHEN transform IN ('crop60', 'h264_q42', 'reordered', 'discontinuous', 'central_text', 'reaction_layout') THEN 'harsh' ELSE 'moderate' END AS severity, sp AS speed, CASE WHEN v THEN identity END AS expected_parent, identity IN ('N18', 'N21', 'N24') AS expected_ambiguity,
CASE WHEN NOT v THEN '' WHEN transform = 'discontinuous' THEN format('2.000-{:.3f};26.000-{:.3f}', 2 + length_s / 2, 26 + length_s / 2) WHEN transform = 'reordered' THEN format('{:.3f}-{:.3f};2.000-{:.3f}', 4 + length_s / 2, 4.0::DOUBLE + length_s, 2 + length_s / 2) ELSE format('2.000-{:.3f}', 2 + length_s * sp) END AS source_intervals,
CASE WHEN NOT v THEN '' WHEN transform IN ('discontinuous', 'reordered') THEN format('0.000-{:.3f};{:.3f}-{:.3f}', length_s / 2, length_s / 2, length_s::DOUBLE) ELSE format('0.000-{:.3f}', length_s::DOUBLE) END AS candidate_intervals
FROM (SELECT *, CASE transform WHEN 'speed075' THEN 0.75::DOUBLE WHEN 'speed125' THEN 1.25 WHEN 'speed150' THEN 1.5 ELSE 1 END AS sp FROM a)""")
def candidate_design(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.3f-%.3f", x["a"], x["b"])), ";")
    own = F.transform("frame_mapping", lambda m: m["candidate"])
    return design(spark).select("candidate_id", "identity", F.col("length_s").cast("bigint"), "transform", "visual_ancestry", "audio_ancestry", "family", "severity", F.col("speed").cast("double"), "expected_parent", "expected_ambiguity", text(F.col("source_intervals")).alias("source_intervals"), text(own).alias("candidate_intervals"))


@query("SELECT sha256(text) AS digest, any_value(text) AS content FROM documents WHERE doc_id % 3 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY sha256(text)")
def artifact_insert(spark, d):
    x = fx.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    stored = x.where("doc_id % 3 = 0").select(F.sha2("content", 256).alias("digest"))
    return evidence.new_artifacts(x.where("doc_id % 3 <> 0").select("content"), stored).select("digest", "content")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id)::BIGINT AS number FROM documents")
def ordinal_ids(spark, d):
    return numbered(fx.table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("number").cast("bigint"))


@query("""SELECT event_id, sha256('{"id":' || event_id || ',"type":"' || event_type || '"}') AS digest FROM events""")
def canonical_digests(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.format_string('{"type": "%s", "id": %d}', "event_type", "event_id").alias("json"))
    return e.select("event_id", canonical.digest_column(F.col("json")).alias("digest"))


@query("SELECT doc_id, strftime(TIMESTAMP '2024-03-01 10:00:00' + to_minutes(CAST(doc_id % 600 AS INTEGER)) - to_hours(2), '%Y-%m-%d %H:%M:%S') AS utc FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 = 1")
def stamp_parsing(spark, d):
    local = F.date_format(F.expr("timestampadd(MINUTE, CAST(doc_id % 600 AS INT), TIMESTAMP_NTZ'2024-03-01 10:00:00')"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(local, F.lit("+02:00"))).otherwise(local)
    utc = F.to_utc_timestamp(canonical.stamp(text), F.expr("current_timezone()"))
    return fx.table(spark, d, "documents").select("doc_id", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(f"WITH {fx.HASHES} SELECT a.id, bit_count(xor(a.hash, b.hash))::BIGINT AS changed FROM hashes a JOIN hashes b ON b.id = a.id - 1")
def adjacent_changes(spark, d):
    h = fx.hashes(spark, d)
    return h.join(h.select((F.col("id") + 1).alias("id"), F.col("hash").alias("before")), "id").select("id", bits.hamming(F.col("hash"), F.col("before")).cast("bigint").alias("changed"))


@query("WITH p AS (SELECT source, list_sort(list(n_chars) FILTER (WHERE lang = 'en')) AS p, list_sort(list(n_chars) FILTER (WHERE lang <> 'en')) AS n FROM documents GROUP BY source) SELECT source, CASE WHEN coalesce(len(p), 0) = 0 OR coalesce(len(n), 0) = 0 THEN 'insufficient_data' WHEN p[len(p) // 2 + 1] <= n[len(n) // 2 + 1] THEN 'inverted_or_collapsed' WHEN len(list_filter(n, lambda x: x >= p[len(p) // 2 + 1])) / len(n) > 0.4 THEN 'high_overlap' WHEN len(list_filter(n, lambda x: x >= p[len(p) // 2 + 1])) / len(n) > 0.15 THEN 'moderate_overlap' ELSE 'low_overlap' END AS hint FROM p")
def overlap_hints(spark, d):
    samples = fx.table(spark, d, "documents").select("source", F.col("n_chars").alias("score"), (F.col("lang") == "en").alias("is_positive"))
    return calibration.overlap_hints(samples, ["source"]).withColumnRenamed("overlap_hint", "hint")


_CHAINS = ((1, "trim", 1.0, False, False, False), (2, "speed", 1.25, False, False, False), (3, "two_fragments", 1.0, True, False, False), (4, "reorder", 1.0, False, True, False), (5, "new_audio", 1.0, False, False, True))


@query(f"""WITH c AS (SELECT * FROM (VALUES {', '.join(map(str, _CHAINS))}) c(chain_no, t, speed, two, reo, rep)), s AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS source_id, 4 + s_suppkey % 20 AS dur FROM supplier),
r AS (SELECT *, length / 2 AS half, greatest(0, least(1, (dur - length) / 4)) AS start FROM s, (VALUES (3.0::DOUBLE), (5.0), (10.0)) l(length), c WHERE length <= dur - 0.5 AND (NOT (two OR reo) OR length >= 5)),
n AS (SELECT *, row_number() OVER (ORDER BY source_id, length, chain_no) AS k FROM r), f AS (SELECT *, floor(1000 * CASE WHEN two THEN 0.5 WHEN reo THEN 2 + half ELSE start END)::BIGINT AS a0, floor(1000 * CASE WHEN two THEN 0.5 + half WHEN reo THEN 2 + 2 * half ELSE start + length * speed END)::BIGINT AS b0, floor(1000 * CASE WHEN two THEN 8 WHEN reo THEN 1 END)::BIGINT AS a1, floor(1000 * CASE WHEN two THEN 8 + half WHEN reo THEN 1 + half END)::BIGINT AS b1 FROM n)
SELECT 'C' || lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INTEGER, '0') AS candidate_id, source_id, length, t AS transforms, a0 || '-' || b0 || coalesce(';' || a1 || '-' || b1, '') AS source_ms, NOT rep AS audio_ancestry FROM f""")
def first_experiment(spark, d):
    sources = fx.table(spark, d, "supplier").select(canonical.padded_id("S", F.col("s_suppkey"), 5).alias("source_id"), (4 + F.col("s_suppkey") % 20).cast("double").alias("duration_s"))
    chains = spark.createDataFrame(list(_CHAINS), "chain_no int, transforms string, speed double, two_fragments boolean, reordered boolean, audio_replaced boolean")
    made = first_candidates(sources, chains, (3.0, 5.0, 10.0))
    text = F.array_join(F.transform("source_intervals_ms", lambda x: F.concat_ws("-", x["start_ms"].cast("string"), x["end_ms"].cast("string"))), ";")
    return made.select("candidate_id", "source_id", "length", "transforms", text.alias("source_ms"), "audio_ancestry")


@query("WITH p AS (SELECT DISTINCT source AS id, CASE WHEN length(source) % 2 = 0 THEN 'calibration' ELSE 'evaluation' END AS part FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(p.part, 'unknown') WHEN doc_id % 3 = 1 THEN coalesce(q.part, 'unknown') ELSE 'unknown' END AS partition FROM documents d LEFT JOIN p ON p.id = d.source AND doc_id % 5 <> 0 LEFT JOIN p q ON q.id = d.source")
def partition_inheritance(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "source")
    k = F.col("doc_id") % 3
    candidates = docs.select("doc_id", F.when(k == 0, F.when(F.col("doc_id") % 5 != 0, F.col("source")).otherwise("none")).alias("expected_parent"), F.when(k == 1, F.col("source")).alias("negative_id"))
    parts = docs.select(F.col("source").alias("id")).distinct().withColumn("partition", F.when(F.length("id") % 2 == 0, "calibration").otherwise("evaluation"))
    return partitioning.inherit(candidates, parts).select("doc_id", "partition")


@query(f"WITH {fx.SCORED}, {_DECIDED_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate, method ORDER BY score DESC, parent) AS n FROM p WHERE method <> 'V-B') SELECT candidate, method, parent, score FROM r WHERE n <= 2 AND score > 0")
def review_leads(spark, d):
    both = _method_pairs(spark, d, "V-C").withColumn("method", F.lit("V-C")).union(_method_pairs(spark, d, "A-chromaprint").withColumn("method", F.lit("A-chromaprint")))
    return methods.leads(both.withColumn("blocks", F.array(F.lit(1))), most=2).select("candidate", "method", "parent", "score")


@query("SELECT doc_id, doc_id % 7 < doc_id % 5 AND doc_id % 5 <= 3 AS interval_ok, doc_id % 3 = 0 AND doc_id % 4 <> 0 AS review_ok, doc_id % 6 > 2 AS period_ok FROM documents")
def input_predicates(spark, d):
    i = F.col("doc_id")
    one = F.array(F.struct((i % 7).cast("double").alias("a"), (i % 5).cast("double").alias("b")))
    state, note = F.when(i % 3 == 0, "insufficient").otherwise("sure"), F.when(i % 4 == 0, " ").otherwise("seen")
    return fx.table(spark, d, "documents").select("doc_id", methods.valid_intervals(one, F.lit(3.0)).alias("interval_ok"), methods.valid_review(state, note).alias("review_ok"), methods.valid_period(F.lit(2), i % 6).alias("period_ok"))


@query("SELECT doc_id AS authorization_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 10 END AS revoked_at FROM documents")
def revocations(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("authorization_id"))
    revoked = docs.where("authorization_id % 3 = 0").select("authorization_id", F.explode(F.array(F.col("authorization_id") % 10, F.col("authorization_id") % 10 + 5)).alias("revoked_at"))
    return evidence.without_revoked(docs, revoked)


@query("""WITH a AS (SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), r AS (SELECT sha256(text) AS sha, count(*) AS l, count(*) FILTER (WHERE doc_id % 9 = 0) AS z FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT doc_id, coalesce(a.n, 0)::BIGINT AS n_exact, a.first AS first_exact, CASE WHEN a.n > 1 THEN 'exact_registration_conflict' WHEN a.n = 1 THEN 'exact_match' ELSE 'no_exact_match' END AS c1, CASE WHEN l > 0 THEN 'recorded' ELSE 'absent' END AS c2, CASE WHEN doc_id % 5 = 0 THEN 'reviewed_support' ELSE 'not_established' END AS c3, CASE WHEN z > 0 THEN 'valid_record' ELSE 'unknown' END AS c7, 'not_determined' AS c9 FROM documents d LEFT JOIN a ON a.sha = sha256(d.text) LEFT JOIN r ON r.sha = sha256(d.text)""")
def claim_states(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    records = docs.where("doc_id % 3 = 0").select(F.col("sha256").alias("child_sha256"), F.when(F.col("doc_id") % 9 == 0, F.col("doc_id")).alias("authorization_id"))
    reviews = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("candidate_id"), F.lit("reviewed_support").alias("visual_state"), F.lit("insufficient").alias("audio_state"))
    out = registry.claims(docs.withColumnRenamed("doc_id", "candidate_id"), docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "asset_id"), records, reviews)
    return out.select(F.col("candidate_id").alias("doc_id"), "n_exact", "first_exact", F.col("c1_exact_asset").alias("c1"), F.col("c2_signed_lineage").alias("c2"), F.col("c3_visual_derivation").alias("c3"), F.col("c7_authorization").alias("c7"), F.col("c9_ownership").alias("c9"))


@query("SELECT event_id AS candidate_id, user_id::VARCHAR AS sha256, event_type AS filename, epoch_us(ts) AS created_at FROM events ORDER BY created_at DESC, candidate_id LIMIT 50")
def newest_candidates(spark, d):
    rows = fx.event_rows(spark, d).select(F.col("event_id").alias("candidate_id"), F.col("user_id").cast("string").alias("sha256"), F.col("event_type").alias("filename"), F.col("us").alias("created_at"))
    return registry.newest(rows)


@query("SELECT n_nationkey AS nation, n_nationkey % 3 <> 0 AS sound FROM nation")
def envelope_verification(spark, d):
    """Signed records of the nations, every third one spoilt after signing."""
    seed = bytes(range(32))
    payload = F.to_json(F.struct("n_nationkey", "n_name"))
    rows = fx.table(spark, d, "nation").select("n_nationkey", signatures.signed(payload, seed).alias("envelope"))
    spoilt = F.when(F.col("n_nationkey") % 3 == 0, F.replace("envelope", F.lit('"n_name":"'), F.lit('"n_name":"x'))).otherwise(F.col("envelope"))
    return rows.select(F.col("n_nationkey").alias("nation"), signatures.sound_column(spoilt, signatures.pem(signatures.public_key(seed))).alias("sound"))


@query("SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 4 <> 1 THEN sha256(text) END AS recorded, CASE WHEN doc_id % 4 = 2 THEN 'x' WHEN doc_id % 4 <> 3 THEN sha256(text) END AS current FROM documents WHERE doc_id % 4 > 0")
def changed_digests(spark, d):
    rows = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 4).alias("k"))
    return readers.changed_digests(rows.where("k <> 1"), rows.where("k <> 3").withColumn("sha256", F.when(F.col("k") == 2, "x").otherwise(F.col("sha256"))))


@query("SELECT source, lang, count(*)::BIGINT AS n, sum(coalesce(CASE WHEN doc_id % 4 > 0 THEN n_chars END, 0))::BIGINT AS wall_s_sum, max(doc_id)::BIGINT AS rss_max, sum(n_chars)::BIGINT AS bytes_sum FROM documents GROUP BY source, lang")
def resource_sums(spark, d):
    docs = fx.table(spark, d, "documents")
    return accounting.resource_sums(docs.select("source", "lang", F.when(F.col("doc_id") % 4 > 0, F.col("n_chars")).alias("wall_s"), F.col("doc_id").alias("rss_bytes"), F.col("n_chars").alias("size_bytes")), ["source", "lang"])


@query(f"WITH {fx.SCORED} SELECT method, CASE WHEN candidate_id % 2 = 0 THEN 'calibration' ELSE 'evaluation' END AS partition, candidate_id, identity, score, truth AS positive, status, length_s::BIGINT AS length_s, transform FROM scored")
def score_export(spark, d):
    """The scores of both partitions, put together."""
    s = fx.scored(spark, d)
    parts = [s.where(F.col("candidate_id") % 2 == k).withColumn("partition", F.lit(p)) for k, p in enumerate(("calibration", "evaluation"))]
    return accounting.score_export(parts[0].unionByName(parts[1])).withColumn("length_s", F.col("length_s").cast("bigint"))


@query("SELECT doc_id, least(doc_id % 4, doc_id % 3)::BIGINT AS n, CASE WHEN least(doc_id % 4, doc_id % 3) > 0 THEN '0-10' END AS first FROM documents")
def interval_zip(spark, d):
    pair = lambda a: F.struct(a.cast("double").alias("a"), (a + 1).cast("double").alias("b"))
    many = lambda n, base: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: pair(i - 1 + base))).otherwise(F.array().cast("array<struct<a:double,b:double>>"))
    z = fx.table(spark, d, "documents").select("doc_id", zipped_intervals(many((F.col("doc_id") % 4).cast("int"), 0), many((F.col("doc_id") % 3).cast("int"), 10)).alias("z"))
    x = F.get("z", 0)
    return z.select("doc_id", F.size("z").cast("bigint").alias("n"), F.concat_ws("-", x["source"]["a"].cast("int").cast("string"), x["candidate"]["a"].cast("int").cast("string")).alias("first")).withColumn("first", F.when(F.col("n") > 0, F.col("first")))


@query(f"""WITH {fx.HASHES}, fr AS (SELECT id // 16 AS seq, row_number() OVER (PARTITION BY id // 16 ORDER BY id) - 1 AS pos, hash FROM hashes), ds AS (SELECT a.seq, a.pos, min(4 * bit_count(xor(a.hash, xor(b.hash, ((1::UBIGINT << (b.seq % 20)::UBIGINT) - 1))))::BIGINT) AS dist FROM fr a JOIN fr b ON b.seq = a.seq AND a.pos % 3 = 0 AND b.pos % 3 = 0 GROUP BY ALL) SELECT seq, round(avg((dist <= 48)::INT), 6) AS support FROM ds GROUP BY seq""")
def descriptor_support(spark, d):
    """Each sequence's hashes, four times over as descriptors, against the same with as many bits flipped as its number
    says."""
    spelt = lambda h: F.unhex(F.repeat(F.lpad(F.hex(h), 16, "0"), 4))
    frames = lambda c: F.array(F.struct(F.array().cast("array<array<double>>").alias("points"), F.transform(c, spelt).alias("descriptors")))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("seq") % 20).cast("int")) - 1
    s = fx.sequences(spark, d).withColumn("other", F.transform("frames", lambda h: h.bitwiseXOR(mask)))
    return s.select("seq", F.round(features.descriptor_support(frames(F.col("frames")), frames(F.col("other"))), 6).alias("support"))


@query(f"{_TOP} SELECT candidate AS candidate_id, parent, distance::BIGINT AS distance, CASE WHEN distance >= 32 THEN 0 ELSE 1 - distance / 32.0 END::DOUBLE AS score FROM top WHERE rank = 1")
def streamed_scores(spark, d):
    """A journal of twenty files, scored by a stream that keeps its keys as state."""
    h, folder = fx.hashes(spark, d), new_folder(spark, "streamed-scores")
    h.where("id % 100 = 0").select(F.col("id").alias("candidate_id"), "hash").repartition(20).write.json(f"{folder}/journal")
    stream = scoring.candidate_stream(spark, f"{folder}/journal", "candidate_id bigint, hash bigint")
    scoring.score_stream(stream, h, f"{folder}/scores", f"{folder}/checkpoint", others=True).awaitTermination()
    return spark.read.parquet(f"{folder}/scores").select("candidate_id", "parent", "distance", "score")


@query("SELECT user_id::VARCHAR AS subject, event_type AS kind, count(*)::BIGINT AS n_events, 0::BIGINT AS n_broken FROM events GROUP BY ALL")
def event_log(spark, d):
    """All events, streamed into a log of one commit a batch, and read back with the breaks of its chain."""
    folder = new_folder(spark, "event-log")
    fx.event_rows(spark, d).select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("subject"), F.to_json(F.struct("event_id", "props")).alias("document")).repartition(20).write.parquet(f"{folder}/events")
    stream = spark.readStream.schema("kind string, subject string, document string").option("maxFilesPerTrigger", 5).parquet(f"{folder}/events")
    ledger.log_stream(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    log = ledger.read_log(spark, f"{folder}/log")
    broken = evidence.chain_violations(log).select("seq", F.lit(1).alias("broken"))
    part = F.split("body", r"\|")
    return log.join(broken, "seq", "left").groupBy(part[1].alias("subject"), part[0].alias("kind")).agg(F.count("*").alias("n_events"), F.count("broken").alias("n_broken"))


@query(f"WITH {fx.HASHES}, {fx.NEAR}, p AS (SELECT a.id AS candidate, b.id AS parent, bit_count(xor(a.hash, b.hash))::BIGINT AS distance FROM near a, near b WHERE a.id % 100 = 0 AND b.id <> a.id), r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY distance, parent) AS rank FROM p) SELECT candidate, parent, distance, rank::BIGINT AS rank FROM r WHERE rank <= 3")
def pruned_search(spark, d):
    h = fx.near_hashes(spark, d)
    return hamming.Search(h.where("id % 100 = 0"), h, 3, others=True).result()


_LONG = f"""WITH {fx.HASHES}, f AS (SELECT id % 4 AS src, id // 4 AS pos, hash FROM hashes),
c AS (SELECT h.id AS cand, f.pos - h.id // 4 AS i, CASE WHEN f.pos % 2 = 1 THEN xor(f.hash, 9::UBIGINT) ELSE f.hash END AS hash FROM hashes h JOIN f ON h.id % 100 = 0 AND f.src = h.id % 4 AND f.pos BETWEEN h.id // 4 AND h.id // 4 + 6), n AS (SELECT cand, count(*) AS n FROM c GROUP BY cand),
t AS (SELECT c.cand, f.src, f.pos - c.i AS o, sum(bit_count(xor(c.hash, f.hash)))::BIGINT AS total, count(*) AS n FROM c, f WHERE f.pos >= c.i GROUP BY c.cand, f.src, o),
b AS (SELECT t.* FROM t JOIN n ON n.cand = t.cand AND n.n = t.n QUALIFY row_number() OVER (PARTITION BY t.cand, src ORDER BY total, o) = 1)"""


@query(f"{_LONG} SELECT n.cand, s.src, n.n::INTEGER AS n, b.total, b.o::BIGINT AS offset FROM n CROSS JOIN (SELECT DISTINCT src FROM f) s LEFT JOIN b ON b.cand = n.cand AND b.src = s.src")
def long_alignment(spark, d):
    """Seven frames from each id divisible by 100 on, every other one changed by two bits, in four sources of all frames."""
    h = fx.hashes(spark, d)
    frames = h.selectExpr("id % 4 AS src", "id div 4 AS pos", "hash")
    starts = h.where("id % 100 = 0").selectExpr("id AS cand", "id % 4 AS src", "id div 4 AS at")
    taken = starts.withColumn("pos", F.explode(F.sequence("at", F.col("at") + 6))).join(frames, ["src", "pos"])
    changed = F.when(F.col("pos") % 2 == 1, F.col("hash").bitwiseXOR(F.lit(9))).otherwise(F.col("hash"))
    clips = taken.groupBy("cand").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", changed.alias("h")))), lambda x: x["h"]).alias("candidate"))
    # Clips are a stated set, and there are four sources.
    pairs = clips.select("cand").crossJoin(frames.select("src").distinct())
    return long.placed(pairs, clips, frames, 7).select("cand", "src", "n", "total", "offset")


_TREE = """WITH l AS (SELECT DISTINCT sha256(doc_id::VARCHAR) AS name, sha256(coalesce(text, '')) AS digest FROM documents),
n2 AS (SELECT left(name, 2) AS prefix, sha256(string_agg(name || ':' || digest, chr(10) ORDER BY name, digest)) AS digest, count(*) AS n FROM l GROUP BY left(name, 2)),
n1 AS (SELECT left(prefix, 1) AS prefix, sha256(string_agg(right(prefix, 1) || ':' || digest, chr(10) ORDER BY prefix)) AS digest, sum(n) AS n FROM n2 GROUP BY left(prefix, 1)),
n0 AS (SELECT '' AS prefix, sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) AS digest, sum(n) AS n FROM n1),
nodes AS (SELECT * FROM n2 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n0)"""


def _document_leaves(spark, d):
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query(f"{_TREE} SELECT prefix, digest, n::BIGINT AS n FROM nodes")
def registry_tree(spark, d):
    return tree.nodes_of(_document_leaves(spark, d), 2)


@query(f"{_TREE} SELECT doc_id, n0.digest AS root, 3::BIGINT AS steps FROM documents, n0 WHERE doc_id % 100 = 0")
def registry_proofs(spark, d):
    """What the proofs of the asked documents give, and how many steps they have."""
    leaves = _document_leaves(spark, d)
    asked = leaves.where("id % 100 = 0")
    found = tree.proofs(tree.nodes_of(leaves, 2), leaves, asked, 2)
    return found.select(F.col("id").alias("doc_id"), tree.proven_root(F.col("digest"), F.col("path")).alias("root"), F.size("path").cast("bigint").alias("steps"))


#: Fixed keys of the queries over a registry, and when they register and check.
_SEED, _AT = bytes(range(32)), "2024-06-01T00:00:00+00:00"


def _registered(spark, d):
    """Assets, derivatives, authorizations and candidates: suppliers register (bytes shared by some), some have a derived
    child, some of these are authorized, and some of the authorizations are revoked; customers have candidates."""
    word = lambda kind, x: F.sha2(F.concat(F.lit(kind), x.cast("string")), 256)
    key = F.col("s_suppkey")
    # Files go by key, as names may repeat.
    suppliers = fx.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("supplier-"), key.cast("string")).alias("file"))
    uploads = suppliers.select(F.col("file").alias("filename"), word("media", key % 90).alias("sha256"), F.lit(10).cast("bigint").alias("size_bytes"), F.lit(8.0).alias("duration_s"), F.col("file").alias("assertion"), F.lit(None).cast("string").alias("features_sha256"))
    none = spark.createDataFrame([], "asset_id string, sha256 string, filename string, size_bytes bigint, duration_s double, created_at string, features_sha256 string, fingerprint_status string, manifest string")
    assets = checkpointed(registry.register(uploads, none, _SEED, _AT)[0])
    owned = assets.join(suppliers, assets.filename == suppliers.file).select("s_suppkey", F.col("asset_id").alias("parent_id"), word("child", key).alias("child_sha256"))
    asks = owned.where("s_suppkey % 6 = 0").select("parent_id", "child_sha256", F.lit("grantee").alias("grantee"), F.lit("2024-01-01T00:00:00Z").alias("valid_from"), F.lit("2025-01-01T00:00:00Z").alias("valid_until"), F.lit("scope").alias("scope_note"))
    granted = checkpointed(registry.authorize(asks, assets, _SEED, _AT)[0])
    revoked = granted.join(owned, ["parent_id", "child_sha256"]).where("s_suppkey % 4 = 0").select("authorization_id", F.lit(_AT).alias("revoked_at"))
    asked = owned.where("s_suppkey % 3 = 0").join(granted.select("parent_id", "child_sha256", "authorization_id"), ["parent_id", "child_sha256"], "left")
    spans = F.array(F.struct(F.lit(0.0).alias("a"), F.lit(4.0).alias("b")))
    derived = checkpointed(registry.derive(asked.select("parent_id", "child_sha256", spans.alias("intervals"), F.array(F.lit("crop")).alias("transformations"), "authorization_id"), assets, granted, _SEED, _AT)[0])
    authorizations = evidence.without_revoked(granted, revoked)
    c = F.col("c_custkey")
    digest = F.when(c % 3 == 0, word("media", c % 120)).when(c % 3 == 1, word("child", F.floor(c / 3) % 140)).otherwise(word("new", c))
    candidates = fx.table(spark, d, "customer").select(c.alias("candidate_id"), digest.alias("sha256"), F.lit("clip.mp4").alias("filename"), F.lit(None).cast("string").alias("features_sha256"))
    return assets, derived, authorizations, candidates


@query("""WITH a AS (SELECT s_suppkey AS k, s_suppkey % 90 AS media FROM supplier), c AS (SELECT c_custkey AS candidate, c_custkey % 3 AS kind, c_custkey % 120 AS media, c_custkey // 3 % 140 AS child FROM customer),
e AS (SELECT candidate, count(k) AS n FROM c LEFT JOIN a ON kind = 0 AND a.media = c.media GROUP BY candidate),
l AS (SELECT candidate, count(k) AS n, count(CASE WHEN k % 6 = 0 AND k % 4 <> 0 THEN k END) AS granted FROM c LEFT JOIN a ON kind = 1 AND a.k = c.child AND k % 3 = 0 GROUP BY candidate)
SELECT candidate, e.n::BIGINT AS n_exact, l.n::BIGINT AS n_lineage, granted::BIGINT AS n_authorized, CASE WHEN e.n > 1 THEN 'exact_registration_conflict' WHEN e.n = 1 THEN 'exact_match' ELSE 'no_exact_match' END AS c1_exact_asset, CASE WHEN l.n > 0 THEN 'recorded' ELSE 'absent' END AS c2_signed_lineage,
CASE candidate % 10 WHEN 0 THEN 'reviewed_support' WHEN 1 THEN 'ambiguous' ELSE 'not_established' END AS c3_visual_derivation, CASE candidate % 10 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'reviewed_support' ELSE 'not_established' END AS c4_audio_derivation, 'not_evaluated' AS c5_transcript_derivation, 'not_evaluated' AS c6_watermark_attribution,
CASE WHEN granted > 0 THEN 'valid_record' ELSE 'unknown' END AS c7_authorization, 'not_evaluated' AS c8_publication, 'not_determined' AS c9_ownership, 0::BIGINT AS unproven FROM e JOIN l USING (candidate)""")
def registry_checks(spark, d):
    """Suppliers register (bytes shared by some), some have a derived child, some of these are authorized, and some of the
    authorizations are revoked; customers' candidates are checked against the tree of the registry, and their receipts are
    verified again."""
    pem = signatures.pem(signatures.public_key(_SEED))
    assets, derived, authorizations, candidates = _registered(spark, d)
    leaves = checkpointed(registry.tree_leaves(assets))
    # A proof has its bucket's lines, so buckets must not grow with the registry.
    depth = tree.depth_for(leaves.count())
    nodes = tree.nodes_of(leaves, depth)
    head = registry.tree_head(nodes, depth, _SEED, _AT).first().envelope
    state = lambda a, b: F.when(F.col("candidate_id") % 10 == a, "reviewed_support").when(F.col("candidate_id") % 10 == b, "ambiguous")
    reviews = candidates.where("candidate_id % 10 < 2").select("candidate_id", state(0, 1).alias("visual_state"), state(1, 0).alias("audio_state"))
    checked = registry.check_by_proofs(candidates, assets, nodes, leaves, head, derived, authorizations, _SEED, pem, _AT, reviews)
    out = checked.withColumn("unproven", F.coalesce(registry.unproven("receipt", pem).cast("bigint"), F.lit(0).cast("bigint")))
    return out.select(F.col("candidate_id").alias("candidate"), "n_exact", "n_lineage", "n_authorized", *registry.CLAIMS, "unproven")


_MIXED = """e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + ([1, 60, 3600, 86400, 2592000, 315360000])[event_id % 6 + 1] AS b FROM events)"""


@query(f"WITH {_MIXED} SELECT l.user_id, count(*)::BIGINT AS n, sum(least(l.b, r.b) - greatest(l.a, r.a))::BIGINT AS shared FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_id % 3 = 0 AND r.event_id % 3 = 1 AND l.a < r.b AND r.a < l.b GROUP BY l.user_id")
def mixed_intervals(spark, d):
    """Overlaps of intervals from a second to ten years."""
    second, length = F.expr("us div 1000000"), F.array(*[F.lit(x).cast("bigint") for x in (1, 60, 3600, 86400, 2592000, 315360000)])
    e = fx.event_rows(spark, d).select(F.col("event_id").alias("id"), "user_id", second.alias("a"), (second + F.element_at(length, (F.col("event_id") % 6 + 1).cast("int"))).alias("b"))
    pairs = evidence.interval_overlaps(e.where("id % 3 = 0"), e.where("id % 3 = 1"), ["user_id"], 60)
    return pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("shared").cast("bigint").alias("shared"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
b AS (SELECT k, i, cos(pi() * (2 * i + 1) * k / 16) * CASE WHEN k = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END AS w FROM (SELECT unnest(range(8)) AS k) CROSS JOIN (SELECT unnest(range(8)) AS i)),
r AS (SELECT vec_id, k AS u, p % 8 AS x, sum(w * v) AS v FROM e JOIN b ON i = p // 8 GROUP BY vec_id, k, p % 8),
c AS (SELECT vec_id, u * 8 + k AS place, CASE WHEN u = 0 AND k = 0 THEN 0 ELSE sum(w * v) END AS v FROM r JOIN b ON i = x GROUP BY vec_id, u, k), m AS (SELECT vec_id, (list_sort(list(v))[32] + list_sort(list(v))[33]) / 2 AS med FROM c GROUP BY vec_id)
SELECT c.vec_id AS id, format('{:016x}', bit_or(CASE WHEN v > med THEN 1::UBIGINT << (63 - place)::UBIGINT ELSE 0::UBIGINT END)) AS hash FROM c JOIN m ON m.vec_id = c.vec_id GROUP BY c.vec_id""")
def patch_hashes(spark, d):
    """Each embedding as a patch of 8 x 8 values: its cosine transform, and a bit for each coefficient above the median."""
    e = fx.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), bits.hash_to_hex(features.patch_hash(F.col("embedding"))).alias("hash"))


#: Fixed thresholds of the four words of a descriptor, of 64 values each, and what a candidate's are off by.
_STEPS, _OFF = (-0.15, -0.05, 0.05, 0.15), 0.01


def _described(spark, d, off, every):
    """(seq, frames): eight frames of eight rows each, with a descriptor a row."""
    word = lambda t: F.aggregate("embedding", F.lit(0).cast("bigint"), lambda w, x: F.shiftleft(w, 1).bitwiseOR(F.when(x.cast("double") > t, 1).otherwise(0).cast("bigint")))
    text = F.concat(*[F.lpad(F.hex(word(t + off)), 16, "0") for t in _STEPS])
    rows = fx.table(spark, d, "embeddings").where(F.floor(F.col("vec_id") / 64) % every == 0)
    points = F.array(F.array((F.col("vec_id") % 320).cast("double"), (F.col("vec_id") % 180).cast("double")))
    one = rows.select(F.floor(F.col("vec_id") / 64).alias("seq"), (F.floor(F.col("vec_id") / 8) % 8).alias("frame"), F.struct("vec_id", points.alias("point"), F.unhex(text).alias("descriptor")).alias("x"))
    frames = one.groupBy("seq", "frame").agg(F.array_sort(F.collect_list("x")).alias("x")).select("seq", F.struct("frame", F.flatten(F.transform("x", lambda x: x["point"])).alias("points"), F.transform("x", lambda x: x["descriptor"]).alias("descriptors")).alias("f"))
    return frames.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.struct(f["points"].alias("points"), f["descriptors"].alias("descriptors"))).alias("frames"))


def _words(off):
    return ", ".join(f"bit_or(CASE WHEN v > {t + off!r}::DOUBLE THEN 1::UBIGINT << (64 - p)::UBIGINT ELSE 0::UBIGINT END) AS w{i}" for i, t in enumerate(_STEPS))


@query(f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings), s AS (SELECT vec_id, {_words(0)} FROM e GROUP BY vec_id), c AS (SELECT vec_id, {_words(_OFF)} FROM e WHERE vec_id // 64 % 4 = 0 GROUP BY vec_id),
n AS (SELECT c.vec_id AS a, s.vec_id AS b, {" + ".join(f"bit_count(xor(c.w{i}, s.w{i}))" for i in range(4))} AS d FROM c, s), near AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY a, b // 64 ORDER BY d, b) = 1),
v AS (SELECT a // 64 AS cand, b // 64 AS src, a // 8 % 8 AS i, b // 8 % 8 AS j, count(*) AS votes FROM near WHERE d <= {features.NEAR} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cand, src, i ORDER BY votes DESC, j) AS rank FROM v WHERE votes >= {features.VOTES})
SELECT cand, src, i::INTEGER AS i, j::INTEGER AS j, votes::BIGINT AS votes, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def voted_frames(spark, d):
    """The source frames that most descriptors of each candidate frame vote for."""
    # Candidates are a stated set, and all sequences are registered.
    sources = _described(spark, d, 0.0, 1).select(F.col("seq").alias("src"), F.col("frames").alias("source"))
    candidates = _described(spark, d, _OFF, 4).select(F.col("seq").alias("cand"), F.col("frames").alias("candidate"))
    return features.most_voted(features.votes_of_all(candidates, sources))


@query("""WITH l AS (SELECT l.doc_id, CASE WHEN l.doc_id % 2 = 0 THEN 'evaluation' ELSE 'calibration' END || '/' || CASE WHEN l.doc_id % 29 = 0 THEN 'failed' ELSE 'evaluated' END AS key FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
f AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 97 = 0) AS bad, count(*) FILTER (WHERE doc_id % 101 = 0) AS gone FROM documents)
SELECT 'results' AS topic, key, count(*)::BIGINT AS n FROM l GROUP BY key UNION ALL SELECT 'artifacts_checked', NULL, n FROM f UNION ALL SELECT 'artifacts_damaged', NULL, bad FROM f UNION ALL SELECT 'files_changed', NULL, gone FROM f UNION ALL SELECT 'passed', NULL, (bad + gone = 0)::BIGINT FROM f""")
def audit_report(spark, d):
    """An audit of results, of artifacts of which some are spoilt, and of a file list that has lost some."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fx.scored(spark, d).where("method = 'V-C'").select(F.when(F.col("candidate_id") % 2 == 0, "evaluation").otherwise("calibration").alias("partition"), F.col("row_status").alias("status"))
    artifacts = docs.select(F.sha2("text", 256).alias("digest"), F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    files = docs.select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    return evidence.audit(rows, artifacts, files, files.where("name % 101 <> 0"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '2020-01-01' WHEN s_suppkey % 3 = 0 THEN '2024-01-01' END AS revoked_at, (s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0)::BIGINT AS events, 0::BIGINT AS unknown FROM supplier
UNION ALL SELECT -1 - s_suppkey, NULL, 0, 1 FROM supplier WHERE s_suppkey % 4 = 0""")
def revocations(spark, d):
    """Suppliers' authorizations, a fifth of them revoked before; a third is revoked, twice each, and ids that are none."""
    key = F.col("s_suppkey")
    known = fx.table(spark, d, "supplier").select(key.alias("authorization_id"), F.when(key % 5 == 0, "2020-01-01").alias("revoked_at"))
    dates = F.array(F.lit("2024-01-01"), F.lit("2024-02-01"))
    asked = known.select(F.when(F.col("authorization_id") % 3 == 0, F.col("authorization_id")).alias("a"), F.when(F.col("authorization_id") % 4 == 0, -1 - F.col("authorization_id")).alias("b")).select(F.explode(F.array("a", "b")).alias("authorization_id")).where("authorization_id IS NOT NULL").withColumn("revoked_at", F.explode(dates))
    after, events, unknown = evidence.revoke(known, asked)
    n = events.select(F.col("subject").alias("authorization_id")).groupBy("authorization_id").agg(F.count("*").alias("events"))
    out = after.join(n, "authorization_id", "left").select(F.col("authorization_id").alias("id"), "revoked_at", F.coalesce("events", F.lit(0)).cast("bigint").alias("events"), F.lit(0).cast("bigint").alias("unknown"))
    return out.unionByName(unknown.select(F.col("authorization_id").alias("id"), F.lit(None).cast("string").alias("revoked_at"), F.lit(0).cast("bigint").alias("events"), F.lit(1).cast("bigint").alias("unknown")))


@query("SELECT DISTINCT sha256(text) AS digest, length(text)::BIGINT AS n_chars FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL")
def digest_store(spark, d):
    """All texts in a store by digest, put twice, and those of the asked documents read back and verified."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    store = sinks.DigestStore(spark, new_folder(spark, "digest-store"), buckets=8)
    store.put(docs)
    store.put(docs)
    asked = docs.where("doc_id % 100 = 0").select(F.sha2("content", 256).alias("digest")).where("digest IS NOT NULL")
    return store.get(asked).select("digest", F.length("content").cast("bigint").alias("n_chars"))


@query("""SELECT 'resigned' AS variant, 'manifest_signer' AS rule, count(*)::BIGINT AS n FROM supplier WHERE s_suppkey % 7 = 0 HAVING count(*) > 0 UNION ALL SELECT 'resigned', 'registry_snapshot', 1 UNION ALL SELECT 'resigned', 'derivative_record', 1
UNION ALL SELECT 'lost', 'registry_snapshot', 1 FROM supplier WHERE s_suppkey % 10 = 5 HAVING count(*) > 0 UNION ALL SELECT 'broken', 'event_chain', 1 UNION ALL SELECT 'forged', 'receipt_signer', 1 UNION ALL SELECT 'forged', 'receipt_not_in_log', 1""")
def bundle_checks(spark, d):
    """One checked candidate's bundle for others to verify, and the rules that it breaks: none as it is; with manifests of
    another signer, without some of the manifests, with a changed event, and with a changed receipt."""
    pem, other = signatures.pem(signatures.public_key(_SEED)), bytes(range(1, 33))
    assets, derived, authorizations, candidates = _registered(spark, d)
    one = checkpointed(registry.check(candidates.where("candidate_id = 1").withColumn("candidate_id", F.col("candidate_id").cast("string")), assets, derived, authorizations, _SEED, pem, _AT))
    digest = canonical.digest_column
    events = assets.select(F.lit("log").alias("log"), F.lit(1).alias("at"), F.concat_ws("|", F.lit("origin_registered"), "asset_id", digest(F.col("manifest"))).alias("body")).unionByName(one.select(F.lit("log").alias("log"), F.lit(2).alias("at"), F.concat_ws("|", F.lit("candidate_verified"), "candidate_id", digest(F.col("receipt"))).alias("body")))
    chain = checkpointed(evidence.build_chain(events, "log", "at", "body"))
    last = chain.join(chain.agg(F.max("seq").alias("seq")), "seq").select("log", "seq", "event_hash")
    marks = checkpointed(evidence.checkpoints(last, other, _AT))
    none = spark.createDataFrame([], "digest string, content string")
    whole = registry.bundle(one, assets, none, derived, authorizations, chain, marks)
    key = F.regexp_extract("filename", r"(\d+)$", 1).cast("bigint")
    numbered_ = assets.select("asset_id", key.alias("k"))
    kept = whole["manifests"].join(numbered_, "asset_id")
    payload = F.get_json_object("manifest", "$.payload")
    variants = {
        "whole": {},
        "resigned": {"manifests": kept.withColumn("manifest", F.coalesce(signatures.signed(F.when(F.col("k") % 7 == 0, payload), other), F.col("manifest"))).drop("k")},
        "lost": {"manifests": kept.where("k % 10 <> 5").drop("k")},
        "broken": {"chain": chain.withColumn("body", F.when(F.col("seq") == 3, "changed").otherwise(F.col("body")))},
        "forged": {"receipt": whole["receipt"].withColumn("receipt", F.replace("receipt", F.lit("recorded"), F.lit("absent")))},
    }
    out = [registry.check_bundle({**whole, **change}, pem, signatures.pem(signatures.public_key(other))).select(F.lit(name).alias("variant"), "rule", "key") for name, change in variants.items()]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.groupBy("variant", "rule").agg(F.count("*").alias("n"))


@query("SELECT 'S' || lpad(doc_id::VARCHAR, 9, '0') AS asset_id, doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS sha256, 'source' AS role, 'evaluation' AS partition FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 1")
def partition_sources(spark, d):
    """The registry of one partition: its sources only, each file's digest held against the registered one."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    role, part = F.when(F.col("doc_id") % 4 == 0, "negative").otherwise("source"), F.when(F.col("doc_id") % 3 == 1, "evaluation").otherwise("calibration")
    assets = docs.select(canonical.padded_id("S", F.col("doc_id"), 9).alias("asset_id"), F.col("doc_id").cast("string").alias("path"), "sha256", role.alias("role"), part.alias("partition"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), "sha256")
    return readers.registry_of(assets, files, "evaluation").select("asset_id", "path", "sha256", "role", "partition")


@query("SELECT l.doc_id, l.quality::BIGINT AS quality, (CASE WHEN l.doc_id % 10 = 0 THEN 1 - l.toxic ELSE l.toxic END)::BIGINT AS toxic FROM labels l WHERE l.doc_id % 10 = 0 OR l.doc_id % 7 = 0")
def label_drift(spark, d):
    """Streamed labels that differ from the fixed design (every tenth does), or that it does not have (every seventh)."""
    fixed = fx.table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))
    streamed = fixed.withColumn("toxic", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return scoring.label_drift(streamed, fixed.where("doc_id % 7 <> 0"), "doc_id", ["quality", "toxic"])


@query("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'not evaluated' ELSE format('{:.3f}', n_chars / 8.0) END AS shown, least(ceil((n_chars % 40) / 8.0 * 2), 7)::INTEGER AS n_frames, coalesce(least(ceil((n_chars % 40) / 8.0 * 2), 7) - 1, 0)::DOUBLE / 2 AS last_frame, bit_count(xor(doc_id, n_chars))::INTEGER AS differing, source AS nested_source, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE source END AS merged, doc_id % 5 <> 0 AS is_digest FROM documents WHERE n_chars % 40 > 0""")
def small_functions(spark, d):
    """Texts of numbers, frame times, differing bits of hexadecimal hashes, nested fields, merged maps and digest tests."""
    docs = fx.table(spark, d, "documents").where("n_chars % 40 > 0")
    times = canonical.frame_times(F.col("n_chars") % 40 / F.lit(8.0), 2.0, 7)
    document = F.to_json(F.struct(F.struct("source").alias("meta")))
    first = F.create_map(F.lit("k"), F.col("source"))
    second = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("second"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    digest = F.when(F.col("doc_id") % 5 == 0, "no digest").otherwise(F.sha2(F.col("source"), 256))
    return docs.select(
        "doc_id", canonical.three_decimals(F.when(F.col("n_chars") % 3 != 0, F.col("n_chars") / F.lit(8.0))).alias("shown"), F.size(times).alias("n_frames"), F.try_element_at(times, F.lit(-1)).alias("last_frame"),
        bits.hamming_hex(bits.hash_to_hex(F.col("doc_id")), bits.hash_to_hex(F.col("n_chars"))).alias("differing"), canonical.nested(document, "meta.source", "none").alias("nested_source"),
        F.element_at(canonical.merged_maps(first, second), "k").alias("merged"), canonical.is_digest(digest).alias("is_digest"),
    )
