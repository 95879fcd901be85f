"""Manifest upgrade, validation, geometry, result cache and clean-up policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as U
from ..operators import ingest as I
from ..operators import manifest as M
from ..operators import retrieval as R
from ..operators import upgrade as G
from ..sources import adapters as A
from .register import query

_ITEMS = f"WITH i AS ({A.ITEMS})"


@query("sf_manifest_upgrade", _ITEMS + """, s AS (SELECT document_id, item_id, row_number() OVER (PARTITION BY document_id ORDER BY timeline_start, layer_order, item_id, CAST(item_type = 'text' AS INT), track_index, item_index) - 1 AS n FROM i WHERE item_type <> 'audio')
 SELECT i.item_id, CASE WHEN document_id % 3 < 2 AND item_type <> 'audio' THEN 0 ELSE fade_in END AS fade_in, CASE WHEN document_id % 3 = 0 AND item_type <> 'audio' THEN s.n ELSE layer_order END AS stack_order,
 CASE WHEN document_id % 3 < 2 AND item_type = 'audio' THEN 'audio-item' END AS source_owner, CASE WHEN document_id % 3 < 2 AND item_type NOT IN ('audio', 'text') THEN 'Original' END AS preset
 FROM i LEFT JOIN s USING (document_id, item_id)""")  # fmt: skip
def manifest_upgrade(spark, d):
    items = A.load(spark, d, A.ITEMS).withColumn("version", (F.col("document_id") % 3 + 1).cast("int")).withColumn("stack_order", F.col("layer_order"))
    return G.upgrade(items).select("item_id", "fade_in", "stack_order", "source_owner", "preset")


@query("sf_alias_conflict", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'r' || CAST(o_custkey % 5 AS VARCHAR) WHEN o_custkey % 3 = 1 THEN CASE WHEN o_orderkey % 5 = o_custkey % 5 THEN 'r' || CAST(o_custkey % 5 AS VARCHAR) END ELSE 'r' || CAST(o_orderkey % 5 AS VARCHAR) END AS revision FROM orders")
def alias_conflict(spark, d):
    name = lambda c: F.concat(F.lit("r"), (F.col(c) % 5).cast("string"))
    k = F.col("o_custkey") % 3
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", G.agreed(F.when(k != 2, name("o_custkey")), F.when(k != 0, name("o_orderkey"))).alias("revision"))


@query("sf_canonical_json", "SELECT s_suppkey, sha256('{{\"media\":[\"m' || CAST(s_suppkey % 3 AS VARCHAR) || '\",\"z\"],\"query\":\"' || s_name || '\",\"top_k\":' || CAST(s_suppkey % 50 + 1 AS VARCHAR) || '}}') AS request_hash FROM supplier")
def canonical_json(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    media = F.array(F.lit("z"), F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string")), F.lit("z"))
    return rows.select("s_suppkey", G.request_hash(media, F.col("s_name"), F.col("s_suppkey") % 50 + 1).alias("request_hash"))


@query("sf_layer_geometry", "SELECT p_partkey, round_even(p_size * 0.05, 0)::BIGINT AS x, greatest(1, round_even(round_even((1 - 0.05 - 0.2) * p_size, 0) * 0.5, 0))::BIGINT AS w, greatest(1, round_even(round_even((1 - 0.25) * p_size * 2, 0) * 0.5, 0))::BIGINT AS h FROM part")
def layer_geometry(spark, d):
    size = F.col("p_size")
    g = U.layer_geometry(size, size * 2, F.lit(0.05), F.lit(0.25), F.lit(0.2), F.lit(0.0), F.lit(0.5))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", g["x"].alias("x"), g["w"].alias("w"), g["h"].alias("h"))


@query("pr_visual_items", _ITEMS + " SELECT item_id, CASE WHEN timeline_start - 10 < 0 THEN 'start must be non-negative' WHEN source_in - 1 < 0 AND item_type = 'video' THEN 'source_in must be non-negative' WHEN opacity_drop > 0.095 THEN 'opacity must be between 0 and 1' END AS error, timeline_start - 10 + duration AS item_end FROM i WHERE item_type IN ('video', 'image', 'overlay')")
def visual_items(spark, d):
    items = A.load(spark, d, A.ITEMS).where(F.col("item_type").isin(*M.VISUAL_TYPES))
    items = items.withColumns({"timeline_start": F.col("timeline_start") - 10, "source_in": F.col("source_in") - 1, "opacity": F.when(F.col("opacity_drop") > 0.095, 1.5).otherwise(1.0)})
    return items.select("item_id", G.item_error().alias("error"), (F.col("timeline_start") + F.col("duration")).alias("item_end"))


@query("st_result_cache", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'miss' WHEN 1 THEN 'corrupt' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'outside scope' ELSE 'hit' END ELSE 'hit' END AS outcome, NOT (doc_id % 4 = 3 OR (doc_id % 4 = 2 AND doc_id % 3 <> 0)) AND doc_id % 5 <> 0 AS written FROM documents".replace("ELSE 'hit' END AS outcome", "ELSE CASE WHEN doc_id % 3 = 0 THEN 'outside scope' ELSE 'hit' END END AS outcome").replace("NOT (doc_id % 4 = 3 OR (doc_id % 4 = 2 AND doc_id % 3 <> 0))", "NOT (doc_id % 4 >= 2 AND doc_id % 3 <> 0)"))
def result_cache(spark, d):
    k = F.col("doc_id")
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (k % 4 != 0).alias("stored"), (k % 4 != 1).alias("valid"), F.array(F.when(k % 3 == 0, "M9").otherwise(" M1")).alias("ids"), F.array(F.lit("m1")).alias("trusted"), (k % 5 != 0).alias("complete"))
    return rows.withColumn("outcome", G.cached_outcome()).select("doc_id", "outcome", ((F.col("outcome") != "hit") & F.col("complete")).alias("written"))


@query("st_stale_points", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'replaced' WHEN 1 THEN 'kept' ELSE 'cleared' END AS transcript, CASE p_partkey % 3 WHEN 0 THEN 'replaced' ELSE 'cleared' END AS audio FROM part")
def stale_points(spark, d):
    state = F.when(F.col("p_partkey") % 3 == 0, "ok").when(F.col("p_partkey") % 3 == 1, "failed").otherwise("no_audio")
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", state.alias("state"))
    return rows.select("p_partkey", G.after_stage("transcript", F.col("state")).alias("transcript"), G.after_stage("audio", F.col("state")).alias("audio"))


@query("wn_item_index", _ITEMS + " SELECT document_id, track_id, max(item_index) + 1 AS items, count(DISTINCT item_index) AS places FROM i GROUP BY ALL")
def item_index(spark, d):
    """Items nested in their track and numbered again by their place."""
    nested = A.load(spark, d, A.ITEMS).groupBy("document_id", "track_id").agg(F.sort_array(F.collect_list(F.struct("item_index", "item_id"))).alias("items"))
    flat = M.numbered_items(nested)
    return flat.groupBy("document_id", "track_id").agg((F.max("item.item_index") + 1).alias("items"), F.count_distinct("item_index").alias("places"))


@query("se_modality_union", f"SELECT 'transcript' AS modality, count(*) AS n FROM ({A.POINTS}) WHERE modality = 'transcript' UNION ALL SELECT 'ocr', count(*) FROM ({A.POINTS}) WHERE modality = 'ocr'")
def modality_union(spark, d):
    points = A.load(spark, d, A.POINTS)
    return R.modality_counts(points)


@query("fl_streams", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'v' WHEN 1 THEN 'a' END AS first_stream, p_partkey % 3 = 1 AS has_audio FROM part")
def streams(spark, d):
    """The first video stream, else the first audio stream; whether there is sound."""
    k = F.col("p_partkey") % 3
    one = lambda t, n: F.struct(F.lit(t).alias("codec_type"), F.lit(n).alias("name"))
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(k == 0, F.array(one("data", "d"), one("video", "v"))).when(k == 1, F.array(one("audio", "a"), one("audio", "b"))).otherwise(F.array(one("data", "d"))).alias("s"))
    return rows.select("p_partkey", I.first_stream(F.col("s"))["name"].alias("first_stream"), I.has_audio(F.col("s")).alias("has_audio"))
