"""How the plans read the tables as hashes, sequences, scored rows and logs; each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import hash_from_coefficients

METHODS = ("V-B", "V-C", "A-chromaprint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, hash) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", hash_from_coefficients(F.col("embedding")).alias("hash"))


HASHES = """v AS (SELECT vec_id AS id, label, i, CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE x::DOUBLE END AS x
  FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
m AS (SELECT id, (list_sort(list(x))[32] + list_sort(list(x))[33]) / 2 AS med FROM v GROUP BY id),
hashes AS (SELECT v.id, any_value(label) AS label, bit_or(CASE WHEN x > med THEN (1::UBIGINT << (64 - i)::UBIGINT) ELSE 0::UBIGINT END) AS hash FROM v JOIN m USING (id) GROUP BY v.id)"""

def near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, hash): the hash of each embedding and three near ones, at one, two and no other bits."""
    variants = F.array(*[F.struct(F.lit(k).alias("k"), F.col("hash").bitwiseXOR(x).alias("hash")) for k, x in enumerate((F.lit(0), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("id") % 61).cast("int")), F.call_function("shiftleft", F.lit(3).cast("bigint"), (F.col("id") % 61).cast("int")), F.lit(0)))])
    return hashes(spark, sf_dir).select("id", F.explode(variants).alias("v")).select((F.col("id") * 4 + F.col("v.k")).alias("id"), F.col("v.hash").alias("hash"))


NEAR = "near AS (SELECT id * 4 + k AS id, xor(hash, x::UBIGINT << (id % 61)::UBIGINT) AS hash FROM hashes, (VALUES (0, 0), (1, 1), (2, 3), (3, 0)) t(k, x))"

FRAMES, FIRST, LENGTH = 16, 3, 7
#: Which sequences are queries.
EVERY = 10


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, frames): hashes of sixteen consecutive vectors."""
    rows = hashes(spark, sf_dir).select(F.floor(F.col("id") / FRAMES).alias("seq"), F.struct("id", "hash").alias("x"))
    return rows.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["hash"]).alias("frames"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`pairs` pairs: candidates (cand, candidate) and sources (src, source)."""
    s = sequences(spark, sf_dir)
    c = s.where(F.col("seq") % EVERY == 0).select(F.col("seq").alias("cand"), F.slice("frames", FIRST + 1, LENGTH).alias("candidate")).where(F.size("candidate") > 0)
    return c, s.select(F.col("seq").alias("src"), F.col("frames").alias("source"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cand, src, candidate, source): seven frames of each queried sequence (those divisible by ``EVERY``) against all
    sequences."""
    c, s = sides(spark, sf_dir)
    # Queries are a stated set, and all sequences are registered.
    return s.crossJoin(c)


PAIRS = f"""{HASHES},
frames AS (SELECT id // {FRAMES} AS seq, row_number() OVER (PARTITION BY id // {FRAMES} ORDER BY id) - 1 AS pos, hash FROM hashes),
sizes AS (SELECT seq, count(*) AS n FROM frames GROUP BY seq),
cands AS (SELECT seq, pos - {FIRST} AS pos, hash, count(*) OVER (PARTITION BY seq) AS n FROM frames WHERE pos BETWEEN {FIRST} AND {FIRST + LENGTH - 1}),
pairs AS (SELECT DISTINCT c.seq AS cand, s.seq AS src, c.n AS n, s.n AS m FROM cands c JOIN sizes s ON c.seq % {EVERY} = 0)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scored rows (candidate, method) made from labelled documents by integer arithmetic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    base = table(spark, sf_dir, "labels").join(docs, "doc_id")
    d = F.col("doc_id")
    lengths = F.array(*[F.lit(x) for x in (1, 2, 3, 5, 10, 15, 30)])
    rows = base.select(
        d.alias("candidate_id"),
        F.col("source").alias("identity"),
        F.element_at(lengths, (d % 7 + 1).cast("int")).alias("length_s"),
        F.when(d % 31 == 0, F.element_at(lengths, (d % 7 + 1).cast("int")) - 1).alias("observed_duration_s"),
        F.when(d % 5 == 0, "harsh").otherwise("moderate").alias("severity"),
        F.concat(F.lit("t"), (d % 4).cast("string")).alias("transform"),
        (F.col("quality") == 1).alias("visual_ancestry"),
        (F.col("toxic") == 0).alias("audio_ancestry"),
        F.col("source").alias("expected_parent"),
        F.when(d % 29 == 0, "failed").otherwise("evaluated").alias("row_status"),
        F.when(d % 23 == 0, "other").otherwise(F.col("source")).alias("top_parent"),
        F.posexplode(F.array(*map(F.lit, METHODS))).alias("k", "method"),
    )
    k = F.col("k") + 1
    truth = F.when(F.col("method").startswith("V-"), F.col("visual_ancestry")).otherwise(F.col("audio_ancestry"))
    down = (F.col("candidate_id") + k) % 19 == 0
    return rows.withColumns(
        {
            "truth": truth,
            "status": F.when(down, "not_evaluated").otherwise("evaluated"),
            "score": F.when(~down, F.least(F.lit(100), (F.col("candidate_id") * 37 * k) % 101 + F.when(truth, 60).otherwise(0)) / F.lit(100.0)),
            "margin": F.when(F.col("candidate_id") % 17 != 0, ((F.col("candidate_id") * 13 + k) % 20) / F.lit(100.0)),
        }
    ).drop("k")


SCORED = """base AS (SELECT l.doc_id AS d, d.source, quality, toxic, ([1, 2, 3, 5, 10, 15, 30])[l.doc_id % 7 + 1] AS len FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
scored AS (SELECT d AS candidate_id, source AS identity, len AS length_s, CASE WHEN d % 31 = 0 THEN len - 1 END AS observed_duration_s,
  CASE WHEN d % 5 = 0 THEN 'harsh' ELSE 'moderate' END AS severity, 't' || (d % 4) AS transform, quality = 1 AS visual_ancestry, toxic = 0 AS audio_ancestry, source AS expected_parent,
  CASE WHEN d % 29 = 0 THEN 'failed' ELSE 'evaluated' END AS row_status, CASE WHEN d % 23 = 0 THEN 'other' ELSE source END AS top_parent, method,
  CASE WHEN method LIKE 'V-%' THEN quality = 1 ELSE toxic = 0 END AS truth, CASE WHEN (d + k) % 19 = 0 THEN 'not_evaluated' ELSE 'evaluated' END AS status,
  CASE WHEN (d + k) % 19 <> 0 THEN least(100, (d * 37 * k) % 101 + CASE WHEN CASE WHEN method LIKE 'V-%' THEN quality = 1 ELSE toxic = 0 END THEN 60 ELSE 0 END) / 100.0::DOUBLE END AS score,
  CASE WHEN d % 17 <> 0 THEN ((d * 13 + k) % 20) / 100.0::DOUBLE END AS margin
  FROM base, (VALUES (1, 'V-B'), (2, 'V-C'), (3, 'A-chromaprint')) t(k, method))"""

def separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored rows with evaluated negatives only and scores that mostly tell the classes apart, as calibration needs."""
    d, truth = F.col("candidate_id"), F.col("truth")
    score = F.when(truth, 55 + d * 7 % 45).otherwise(d * 37 % 57 + F.when(d % 97 == 0, 40).otherwise(0)) / F.lit(100.0)
    return scored(spark, sf_dir).withColumns({"status": F.lit("evaluated"), "row_status": F.lit("evaluated"), "score": score})


SEPARABLE = f"""{SCORED}, easy AS (SELECT * REPLACE ('evaluated' AS status, 'evaluated' AS row_status, CASE WHEN truth THEN 55 + candidate_id * 7 % 45 ELSE candidate_id * 37 % 57 + CASE WHEN candidate_id % 97 = 0 THEN 40 ELSE 0 END END / 100.0::DOUBLE AS score) FROM scored)"""

def fusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one visual and one audio method, each by its own ancestry (the audio one differs for every eleventh
    candidate), with scores that mostly tell the classes apart and few close margins."""
    d = F.col("candidate_id")
    rows = scored(spark, sf_dir).where("method IN ('V-C', 'A-chromaprint')").withColumn("audio_ancestry", F.col("visual_ancestry") != (d % 11 == 0))
    visual = F.col("method") == "V-C"
    truth = F.when(visual, F.col("visual_ancestry")).otherwise(F.col("audio_ancestry"))
    score = F.when(truth, 55 + F.when(visual, d * 7).otherwise(d * 11) % 45).otherwise(F.when(visual, d * 37).otherwise(d * 53) % 57 + F.when(d % 97 == 0, 40).otherwise(0)) / F.lit(100.0)
    margin = F.when(d % 17 != 0, ((d * 13 + F.when(visual, 2).otherwise(3)) % 20 + 4) / F.lit(100.0))
    return rows.withColumns({"truth": truth, "status": F.lit("evaluated"), "row_status": F.lit("evaluated"), "score": score, "margin": margin})


FUSABLE = f"""{SCORED}, mixed AS (SELECT * REPLACE (visual_ancestry <> (candidate_id % 11 = 0) AS audio_ancestry) FROM scored WHERE method IN ('V-C', 'A-chromaprint')),
judged AS (SELECT * REPLACE (CASE WHEN method = 'V-C' THEN visual_ancestry ELSE audio_ancestry END AS truth) FROM mixed),
fusable AS (SELECT * REPLACE ('evaluated' AS status, 'evaluated' AS row_status, CASE WHEN truth THEN 55 + CASE method WHEN 'V-C' THEN candidate_id * 7 ELSE candidate_id * 11 END % 45 ELSE CASE method WHEN 'V-C' THEN candidate_id * 37 ELSE candidate_id * 53 END % 57 + CASE WHEN candidate_id % 97 = 0 THEN 40 ELSE 0 END END / 100.0::DOUBLE AS score,
  CASE WHEN candidate_id % 17 <> 0 THEN ((candidate_id * 13 + CASE method WHEN 'V-C' THEN 2 ELSE 3 END) % 20 + 4) / 100.0::DOUBLE END AS margin) FROM judged)"""

THRESHOLD, MINIMUM = 0.6, 5

DECIDED = f"""{SCORED},
decided AS (SELECT *, CASE WHEN row_status <> 'evaluated' OR status <> 'evaluated' OR score IS NULL THEN 'unavailable_evidence' WHEN coalesce(observed_duration_s, length_s) < {MINIMUM} OR score < {THRESHOLD} THEN 'duration_or_score'
  WHEN margin < 0.05 THEN 'competing_registered_parents' ELSE 'qualified_score_and_margin' END AS reason FROM scored),
states AS (SELECT *, CASE reason WHEN 'qualified_score_and_margin' THEN 'supported' WHEN 'competing_registered_parents' THEN 'AMBIGUOUS' ELSE 'insufficient' END AS state,
  CASE WHEN reason = 'unavailable_evidence' THEN status ELSE 'evaluated' END AS processing, CASE WHEN reason = 'qualified_score_and_margin' THEN top_parent END AS parent FROM decided)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("us"))
