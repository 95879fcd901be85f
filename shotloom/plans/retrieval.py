"""Retrieval queries over the supplied embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources import adapters as A
from .register import query

SCOPE, K = ["m0", "m3", "m7"], 50

_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_SCORED = f"""WITH p AS ({A.POINTS}), s AS (SELECT p.*, list_dot_product(vector, q) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(q, q))) AS score
 FROM p, {_Q} WHERE media_id IN ('m0', 'm3', 'm7')), r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 50)"""
_GOOD = "shot_id IS NOT NULL AND shot_id <> '' AND media_id <> ''"
_FUSED = _SCORED + f""", f AS (SELECT shot_id, sum(1.0::DOUBLE / (60 + rank)) AS score, arg_min(media_id, ord * 1000 + rank) AS media_id, arg_min(start_seconds, ord * 1000 + rank) AS start_seconds,
 greatest(0, max(CASE WHEN modality = 'transcript' THEN score END)) AS score_transcript, greatest(0, max(CASE WHEN modality = 'ocr' THEN score END)) AS score_ocr,
 string_agg(CASE WHEN trim(text) <> '' THEN modality || ':' || rank || ':' || trim(regexp_replace(text, '\\s+', ' ', 'g')) END, '|' ORDER BY ord, rank) AS evidence
 FROM r WHERE {_GOOD} GROUP BY shot_id)"""


def _points(spark, d):
    points = A.load(spark, d, A.POINTS)
    vector = points.where("vec_id = 0").select("vector").first()
    return points, list(vector[0]) if vector else []


@query("vs_cosine_topk", _SCORED + " SELECT vec_id, media_id, round(score, 9) AS score, rank FROM r WHERE modality = 'transcript'")
def cosine_topk(spark, d):
    points, q = _points(spark, d)
    return R.ranked_hits(points, q, SCOPE, K, ("transcript",)).select("vec_id", "media_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vs_modality_topk", _SCORED + f" SELECT modality, vec_id, shot_id, rank, ({_GOOD}) AS usable FROM r")
def modality_topk(spark, d):
    points, q = _points(spark, d)
    return R.ranked_hits(points, q, SCOPE, K).select("modality", "vec_id", "shot_id", F.col("rank").cast("long").alias("rank"), R.complete_payload().alias("usable"))


@query("vs_fused_topk", _FUSED + " SELECT shot_id, media_id, start_seconds, round(score, 12) AS score FROM f ORDER BY f.score DESC, start_seconds, shot_id LIMIT 50")
def fused_topk(spark, d):
    points, q = _points(spark, d)
    return R.search(points, q, SCOPE, K).select("shot_id", "media_id", "start_seconds", F.round("score", 12).alias("score"))


@query("vs_modality_scores", _FUSED + " SELECT shot_id, round(score_transcript, 9) AS score_transcript, round(score_ocr, 9) AS score_ocr FROM f")
def modality_scores(spark, d):
    points, q = _points(spark, d)
    return R.fuse(R.ranked_hits(points, q, SCOPE, K)).select("shot_id", F.round("score_transcript", 9).alias("score_transcript"), F.round("score_ocr", 9).alias("score_ocr"))


@query("vs_evidence", _FUSED + " SELECT shot_id, coalesce(evidence, '') AS evidence FROM f")
def evidence(spark, d):
    points, q = _points(spark, d)
    line = lambda e: F.concat_ws(":", e["modality"], e["rank"].cast("string"), e["snippet"])
    return R.fuse(R.ranked_hits(points, q, SCOPE, K)).select("shot_id", F.array_join(F.transform("evidence", line), "|").alias("evidence"))


@query("vs_candidates", _SCORED + f" SELECT modality, count(*) AS candidates, count(*) FILTER ({_GOOD}) AS usable FROM r GROUP BY modality")
def candidates(spark, d):
    points, q = _points(spark, d)
    return R.ranked_hits(points, q, SCOPE, K).groupBy("modality").agg(F.count("*").alias("candidates"), F.count_if(R.complete_payload()).alias("usable"))


@query("vs_neighbours_attached", _FUSED + """, e AS (SELECT shot_id AS src, lead(shot_id) OVER (PARTITION BY media_id ORDER BY vec_id) AS dst FROM p WHERE modality = 'transcript' AND shot_id IS NOT NULL), t AS (SELECT * FROM f ORDER BY f.score DESC, start_seconds, shot_id LIMIT 50)
 SELECT t.shot_id, (SELECT min(src) FROM e WHERE dst = t.shot_id) AS prev_id, (SELECT min(dst) FROM e WHERE src = t.shot_id) AS next_id FROM t""")  # fmt: skip
def neighbours_attached(spark, d):
    from pyspark.sql import Window

    points, q = _points(spark, d)
    own = Window.partitionBy("media_id").orderBy("vec_id")
    edges = points.where("modality = 'transcript' and shot_id is not null").select(F.col("shot_id").alias("src"), F.lead("shot_id").over(own).alias("dst")).where("dst is not null")
    return R.search(points, q, SCOPE, K, edges=edges).select("shot_id", "prev_id", "next_id")


@query("vs_l2_normalized", f"WITH p AS ({A.POINTS}) SELECT vec_id, round(list_sum(list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector)))), 9) AS total FROM p")
def normalized(spark, d):
    points = A.load(spark, d, A.POINTS)
    return points.select("vec_id", F.round(F.aggregate(R.l2_normalize(F.col("vector")), F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


@query("vs_snippet", "SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 280) AS snippet FROM documents")
def snippets(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", R.snippet(F.col("text")).alias("snippet"))


_KINDS = (["ocr", "transcript", "ocr"], ["visual"], ["audio", "ocr"], [], ["transcript"])
_LISTS = "[" + ", ".join("CAST([" + ", ".join(f"'{m}'" for m in k) + "] AS VARCHAR[])" for k in _KINDS) + "]"
#: A request for each part: its modalities, its number of media and its query.
_REQUESTS = f"(SELECT p_partkey AS request_id, {_LISTS}[p_partkey % 5 + 1] AS modalities, p_size % 4 AS n_media, CASE WHEN p_size % 7 = 0 THEN '  ' ELSE p_name END AS query FROM part)"


def _requests(spark, d):
    lists = F.array(*(F.array(*(F.lit(m) for m in k)).cast("array<string>") for k in _KINDS))
    rows = spark.read.parquet(f"{d}/part.parquet")
    return rows.select(F.col("p_partkey").alias("request_id"), F.get(lists, (F.col("p_partkey") % 5).cast("int")).alias("modalities"), (F.col("p_size") % 4).alias("n_media"), F.when(F.col("p_size") % 7 == 0, "  ").otherwise(F.col("p_name")).alias("query"))


@query("vs_modality_resolution", f"SELECT request_id, array_to_string(list_filter(['transcript', 'ocr'], lambda x: list_contains(modalities, x)), ',') AS searched, len(list_filter(list_distinct(modalities), lambda x: NOT list_contains(['transcript', 'ocr'], x))) AS unsupported FROM {_REQUESTS}")
def modality_resolution(spark, d):
    m = F.col("modalities")
    return _requests(spark, d).select("request_id", F.array_join(R.searched(m), ",").alias("searched"), F.size(R.unsupported(m)).cast("long").alias("unsupported"))


@query("vs_completeness", f"SELECT request_id, short_circuit, short_circuit IS NULL AND len(list_filter(modalities, lambda x: NOT list_contains(['transcript', 'ocr'], x))) = 0 AS complete FROM (SELECT *, CASE WHEN n_media = 0 THEN 'no media' WHEN trim(query) = '' THEN 'blank query' WHEN len(list_filter(['transcript', 'ocr'], lambda x: list_contains(modalities, x))) = 0 THEN 'no searchable modality' END AS short_circuit FROM {_REQUESTS})")
def completeness(spark, d):
    own = (F.col("n_media"), F.col("query"), F.col("modalities"))
    return _requests(spark, d).select("request_id", R.short_circuit(*own).alias("short_circuit"), R.complete(*own).alias("complete"))
