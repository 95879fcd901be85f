"""Vector top-k, rank fusion, evidence and result shaping. Everything is one declarative plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank offset of reciprocal rank fusion, evidence rows of a shot, characters of a snippet. Fixed values.
RANK_OFFSET, MAX_EVIDENCE, SNIPPET = 60, 4, 280
#: Searchable modalities in their order. Fixed values.
MODALITIES = ("transcript", "ocr")
MAX_TOP_K = 50


def cosine(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    return dot(vector, q) / (F.sqrt(dot(vector, vector)) * F.lit(norm))


def l2_normalize(vector: Column, least: float = 1e-12) -> Column:
    """Unit vectors; those of norm <= least are returned as they are."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.when(norm <= least, vector).otherwise(F.transform(vector, lambda x: x / norm))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def snippet(text: Column) -> Column:
    return F.left(collapse_space(text), F.lit(SNIPPET))


def complete_payload() -> Column:
    """A hit can be used if its ids are non-empty and its times are present."""
    return (F.coalesce("shot_id", F.lit("")) != "") & (F.coalesce("media_id", F.lit("")) != "") & F.col("start_seconds").isNotNull() & F.col("end_seconds").isNotNull()


def ranked_hits(points: DataFrame, query: list[float], media_ids: list[str], top_k: int, modalities=MODALITIES) -> DataFrame:
    """Top hits of each modality in the trusted scope, numbered from 1. Unusable hits hold their rank.

    The scope filter stands below the scores; `rank <= k` becomes a group limit before the shuffle.
    Ties go by vec_id. The vector is dropped as soon as it is scored.
    """
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")
    scope = points.where(F.col("media_id").isin(media_ids) & F.col("modality").isin(list(modalities)))
    scored = scope.withColumn("score", cosine(F.col("vector"), query)).drop("vector")
    best = Window.partitionBy("modality").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def fuse(hits: DataFrame) -> DataFrame:
    """(shot_id, score) plus the attributes of the first hit seen, for usable hits."""
    order = F.struct("ord", "rank")
    return hits.where(complete_payload()).groupBy("shot_id").agg(
        F.sum(F.lit(1.0) / (F.lit(RANK_OFFSET) + F.col("rank"))).alias("score"),
        F.min_by(F.struct("media_id", "start_seconds", "end_seconds"), order).alias("first"),
        F.greatest(F.lit(0.0), F.max(F.when(F.col("modality") == "transcript", F.coalesce("score", F.lit(0.0))))).alias("score_transcript"),
        F.greatest(F.lit(0.0), F.max(F.when(F.col("modality") == "ocr", F.coalesce("score", F.lit(0.0))))).alias("score_ocr"),
        F.slice(F.sort_array(F.collect_list(F.when(F.coalesce(collapse_space(F.col("text")), F.lit("")) != "", F.struct("ord", "rank", "modality", F.col("score").alias("raw"), snippet(F.col("text")).alias("snippet"))))), 1, MAX_EVIDENCE).alias("evidence"),
    ).select("shot_id", "first.*", "score", "score_transcript", "score_ocr", "evidence")


def top_shots(fused: DataFrame, top_k: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), "start_seconds", "shot_id").limit(top_k)


def with_neighbours(shots: DataFrame, edges: DataFrame) -> DataFrame:
    """prev_id and next_id from NEXT edges (src, dst): one plan for all shots; the least id if there are several."""
    before = edges.groupBy(F.col("dst").alias("shot_id")).agg(F.min("src").alias("prev_id"))
    after = edges.groupBy(F.col("src").alias("shot_id")).agg(F.min("dst").alias("next_id"))
    return shots.join(before, "shot_id", "left").join(after, "shot_id", "left")


def search(points: DataFrame, query: list[float], media_ids: list[str], top_k: int = 8, modalities=MODALITIES, edges: DataFrame | None = None) -> DataFrame:
    """The whole retrieval. Empty scope, no query or no searchable modality give an empty result without a scan."""
    wanted = [m for m in MODALITIES if m in modalities]
    if not media_ids or not query or not wanted:
        points, query, media_ids = points.limit(0), query or [0.0], media_ids or [""]
    top = top_shots(fuse(ranked_hits(points, query, media_ids, top_k, wanted or MODALITIES)), top_k)
    return with_neighbours(top, edges) if edges is not None else top


def searched(modalities: Column) -> Column:
    """The requested modalities that can be searched, each once, in the fixed order."""
    return F.array_intersect(F.array(*(F.lit(m) for m in MODALITIES)), modalities)


def unsupported(modalities: Column) -> Column:
    return F.array_except(modalities, F.array(*(F.lit(m) for m in MODALITIES)))


def short_circuit(n_media: Column, query: Column, modalities: Column) -> Column:
    """Why a request needs no search: no media, then a blank query, then no searchable modality; null if it needs one."""
    return F.when(n_media == 0, "no media").when(F.trim(query) == "", "blank query").when(F.size(searched(modalities)) == 0, "no searchable modality")


def complete(n_media: Column, query: Column, modalities: Column) -> Column:
    """Whether a request's result can be whole: it is searched, and every modality it asks for is."""
    return short_circuit(n_media, query, modalities).isNull() & (F.size(unsupported(modalities)) == 0)


def modality_counts(points: DataFrame, modalities=MODALITIES) -> DataFrame:
    """(modality, n) of the union of the modalities' lists, in one scan; 0 for a modality without points."""
    sums = points.agg(*(F.count_if(F.col("modality") == m).alias(m) for m in modalities))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(m).alias("modality"), F.col(m).alias("n")) for m in modalities))))


def search_warnings(requested: list[str], media_ids: list[str], missing_collections: list[str] = ()) -> list[str]:
    """Warnings in order, each once."""
    found = [f"unsupported modality: {m}" for m in requested if m not in MODALITIES]
    if not media_ids:
        found.append("no trusted media")
    if not any(m in MODALITIES for m in requested):
        found.append("no searchable modality")
    found += [f"collection unavailable: {c}" for c in missing_collections]
    return list(dict.fromkeys(found))
