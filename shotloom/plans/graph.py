"""Graph and keyed-table queries over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stores as S
from ..operators.retrieval import with_neighbours
from ..schemas import COLLECTIONS
from ..sources import adapters as A
from .register import query

_SHOTS = f"WITH s AS ({A.SHOTS})"


@query("gr_next_edges", _SHOTS + " SELECT * FROM (SELECT shot_id AS src, lead(shot_id) OVER (PARTITION BY media_id ORDER BY shot_index) AS dst FROM s) WHERE dst IS NOT NULL")
def next_edges(spark, d):
    return S.next_edges(A.load(spark, d, A.SHOTS))


@query("gr_neighbours", _SHOTS + " SELECT shot_id, lag(shot_id) OVER w AS prev_id, lead(shot_id) OVER w AS next_id FROM s WINDOW w AS (PARTITION BY media_id ORDER BY shot_index)")
def neighbours(spark, d):
    shots = A.load(spark, d, A.SHOTS)
    return with_neighbours(shots.select("shot_id"), S.next_edges(shots))


@query("gr_belongs_to", _SHOTS + " SELECT shot_id AS src, media_id AS dst FROM s WHERE hash_even = 0".replace("hash_even = 0", "CAST(substr(media_id, 2) AS BIGINT) % 2 = 0"))
def belongs_to(spark, d):
    shots = A.load(spark, d, A.SHOTS)
    videos = shots.select("media_id").distinct().where(F.substr("media_id", F.lit(2)).cast("long") % 2 == 0)
    return S.belongs_to(shots, videos)


def _gone(shots):
    return shots.select("media_id").distinct().where(F.substr("media_id", F.lit(2)).cast("long") % 3 == 0)


@query("gr_delete_media", _SHOTS + """, e AS (SELECT media_id, shot_id AS src, lead(shot_id) OVER (PARTITION BY media_id ORDER BY shot_index) AS dst FROM s)
 SELECT 'shot' AS what, shot_id AS id FROM s WHERE CAST(substr(media_id, 2) AS BIGINT) % 3 <> 0 UNION ALL SELECT 'edge', src FROM e WHERE dst IS NOT NULL AND CAST(substr(media_id, 2) AS BIGINT) % 3 <> 0""")  # fmt: skip
def delete_media(spark, d):
    shots = A.load(spark, d, A.SHOTS)
    left, edges = S.without_media(shots, S.next_edges(shots), _gone(shots))
    return left.select(F.lit("shot").alias("what"), F.col("shot_id").alias("id")).unionByName(edges.select(F.lit("edge").alias("what"), F.col("src").alias("id")))


@query("sk_graph_upsert", f"SELECT media_id, duration, source FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY source DESC) r FROM (SELECT media_no AS media_id, probed_duration AS duration, 'base' AS source FROM ({A.METADATA}) UNION ALL SELECT media_no, requested_duration, 'update' FROM ({A.METADATA}) WHERE media_no % 3 = 1 UNION ALL SELECT media_no + 1000000, requested_duration, 'update' FROM ({A.METADATA}) WHERE media_no % 50 = 0)) WHERE r = 1")
def graph_upsert(spark, d):
    rows = A.load(spark, d, A.METADATA)
    base = rows.select(F.col("media_no").alias("media_id"), F.col("probed_duration").alias("duration"), F.lit("base").alias("source"))
    new = rows.where("media_no % 3 = 1").select(F.col("media_no").alias("media_id"), F.col("requested_duration").alias("duration"), F.lit("update").alias("source"))
    more = rows.where("media_no % 50 = 0").select((F.col("media_no") + 1000000).alias("media_id"), F.col("requested_duration").alias("duration"), F.lit("update").alias("source"))
    return S.upsert(S.greatest(base, "media_id"), new.unionByName(more), "media_id")


@query("sk_replace_shots", _SHOTS + " SELECT media_id, shot_id, 'old' AS version FROM s WHERE CAST(substr(media_id, 2) AS BIGINT) % 3 <> 0 UNION ALL SELECT media_id, shot_id, 'new' FROM s WHERE CAST(substr(media_id, 2) AS BIGINT) % 6 = 0 AND shot_index % 2 = 0")
def replace_shots(spark, d):
    """Every third media is replaced; every sixth gets new shots, the others are cleared."""
    shots = A.load(spark, d, A.SHOTS)
    new = shots.where((F.substr("media_id", F.lit(2)).cast("long") % 6 == 0) & (F.col("shot_index") % 2 == 0)).select("media_id", "shot_id", F.lit("new").alias("version"))
    return S.replace_by_key(shots.select("media_id", "shot_id", F.lit("old").alias("version")), new, _gone(shots), "media_id")


@query("sk_replace_points", f"WITH p AS ({A.POINTS}) SELECT vec_id, media_id, 'old' AS version FROM p WHERE media_id NOT IN ('m1', 'm2') UNION ALL SELECT vec_id, media_id, 'new' FROM p WHERE media_id = 'm1' AND modality = 'ocr'")
def replace_points(spark, d):
    points = A.load(spark, d, A.POINTS)
    keys = spark.createDataFrame([("m1",), ("m2",)], "media_id string")
    new = points.where("media_id = 'm1' and modality = 'ocr'").select("vec_id", "media_id", F.lit("new").alias("version"))
    return S.replace_by_key(points.select("vec_id", "media_id", F.lit("old").alias("version")), new, keys, "media_id")


@query("sk_collection_check", "SELECT vec_id FROM embeddings WHERE len(embedding) <> CASE WHEN vec_id % 100 = 7 THEN -1 ELSE 64 END")
def collection_check(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 100 == 7, "unknown").otherwise("shots_test").alias("collection"))
    return S.wrong_points(rows, COLLECTIONS | {"shots_test": 64}).select("vec_id")
