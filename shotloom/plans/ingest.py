"""Ingestion queries: intervals, OCR, metadata, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import intervals as V
from ..sources import adapters as A
from .register import query


@query("jn_transcript_overlap", f"""WITH s AS ({A.SEGMENTS}), g AS ({A.GRID}) SELECT g.media_id, g.shot_id, coalesce(trim(string_agg(s.text, ' ' ORDER BY s.pos)), '') AS text, count(s.pos) AS segment_count
 FROM g LEFT JOIN s ON s.media_id = g.media_id AND greatest(s.start_seconds, g.start_seconds) < least(s.end_seconds, g.end_seconds) GROUP BY g.media_id, g.shot_id""")  # fmt: skip
def transcript_overlap(spark, d):
    return V.align_transcript(A.load(spark, d, A.GRID), A.load(spark, d, A.SEGMENTS))


@query("fl_blank_segments", f"SELECT media_id, pos, trim(text) AS text FROM ({A.SEGMENTS}) WHERE trim(text) <> ''")
def blank_segments(spark, d):
    from ..operators.retrieval import collapse_space

    return A.load(spark, d, A.SEGMENTS).where(collapse_space(F.col("text")) != "").select("media_id", "pos", F.trim("text").alias("text"))


_FRAMES = f"""WITH b AS ({A.BLOCKS}), f AS (SELECT frame_id, min(media_no) AS media_no FROM b GROUP BY frame_id), k AS (SELECT * FROM b WHERE confidence >= 0.3 AND trim(text) <> ''),
 o AS (SELECT f.frame_id, f.media_no, coalesce(string_agg(trim(k.text), ' ' ORDER BY k.pos), '') AS text, count(k.pos) AS block_count, avg(k.confidence) AS mean_confidence FROM f LEFT JOIN k ON k.frame_id = f.frame_id GROUP BY f.frame_id, f.media_no)"""


def _frames(spark, d):
    blocks = A.load(spark, d, A.BLOCKS)
    return I.ocr_by_frame(blocks, blocks.groupBy("frame_id").agg(F.min("media_no").alias("media_no")))


@query("ag_ocr_frames", _FRAMES + " SELECT frame_id, text, block_count, round(mean_confidence, 9) AS mean_confidence FROM o")
def ocr_frames(spark, d):
    return _frames(spark, d).select("frame_id", "text", "block_count", F.round("mean_confidence", 9).alias("mean_confidence"))


@query("ag_ocr_media", _FRAMES + " SELECT media_no, sum(block_count)::BIGINT AS block_count, round(avg(mean_confidence), 9) AS mean_confidence, count(*) FILTER (text <> '') AS text_frames FROM o GROUP BY media_no")
def ocr_media(spark, d):
    return I.ocr_by_media(_frames(spark, d)).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("fl_ocr_blocks", f"SELECT frame_id, pos FROM ({A.BLOCKS}) WHERE confidence >= 0.3 AND trim(text) <> ''")
def ocr_blocks(spark, d):
    return I.kept_blocks(A.load(spark, d, A.BLOCKS)).select("frame_id", F.col("pos").cast("long").alias("pos"))


@query("ag_transcript_media", f"SELECT media_id, sha256(coalesce(string_agg(trim(text), ' ' ORDER BY pos) FILTER (trim(text) <> ''), '')) AS text_hash, count(*) AS segment_count FROM ({A.SEGMENTS}) GROUP BY media_id")
def transcript_media(spark, d):
    return I.transcript_by_media(A.load(spark, d, A.SEGMENTS))


@query("jn_metadata_merge", f"SELECT media_no, coalesce(nullif(probed_duration, 0), requested_duration) AS duration, coalesce(nullif(probed_codec, ''), requested_codec) AS codec, coalesce(nullif(probed_width, 0), requested_width) AS width FROM ({A.METADATA})")
def metadata_merge(spark, d):
    c = F.col
    return A.load(spark, d, A.METADATA).select("media_no", I.prefer(c("probed_duration"), c("requested_duration"), 0.0).alias("duration"), I.prefer(c("probed_codec"), c("requested_codec"), "").alias("codec"), I.prefer(c("probed_width"), c("requested_width"), 0).alias("width"))


@query("pr_fallback_shots", f"WITH s AS ({A.SHOTS}), m AS (SELECT DISTINCT media_id, 12.5 AS duration_seconds FROM s) SELECT m.media_id, coalesce(s.shot_index, 0) AS shot_index, coalesce(s.start_seconds, 0) AS start_seconds, coalesce(s.end_seconds, greatest(0, m.duration_seconds)) AS end_seconds FROM m LEFT JOIN (SELECT * FROM s WHERE CAST(substr(media_id, 2) AS BIGINT) % 4 <> 0) s ON s.media_id = m.media_id")
def fallback_shots(spark, d):
    shots = A.load(spark, d, A.SHOTS)
    media = shots.select("media_id").distinct().withColumn("duration_seconds", F.lit(12.5))
    return I.with_fallback_shot(media, shots.where(F.substr("media_id", F.lit(2)).cast("long") % 4 != 0))


@query("pr_shot_rows", f"SELECT shot_id, greatest(0, end_seconds - start_seconds) AS duration_seconds, greatest(0, start_seconds + (end_seconds - start_seconds) / 2) AS midpoint FROM ({A.SHOTS})")
def shot_rows(spark, d):
    rows = I.shot_rows(A.load(spark, d, A.SHOTS))
    return rows.select("shot_id", "duration_seconds", I.midpoint(F.col("start_seconds"), F.col("duration_seconds")).alias("midpoint"))


@query("pr_payloads", f"SELECT shot_id || ':transcript' AS point_id, shot_id, media_id, 'transcript' AS modality, start_seconds, end_seconds, length(text) AS n FROM ({A.SHOTS}) WHERE trim(text) <> '' UNION ALL SELECT DISTINCT media_id || ':audio', media_id || ':audio', media_id, 'audio', 0, 9.5, 0 FROM ({A.SHOTS})")
def payloads(spark, d):
    from ..operators.retrieval import collapse_space

    shots = A.load(spark, d, A.SHOTS)
    a = shots.where(collapse_space(F.col("text")) != "").select(I.shot_payload("transcript").alias("p"))
    b = shots.select("media_id").distinct().select("media_id", F.lit(9.5).alias("duration_seconds"), F.lit("").alias("text")).select(I.media_payload("audio").alias("p"))
    return a.unionByName(b).select(F.col("p.pointId").alias("point_id"), F.col("p.shotId").alias("shot_id"), F.col("p.mediaId").alias("media_id"), "p.modality", F.col("p.startSeconds").alias("start_seconds"), F.col("p.endSeconds").alias("end_seconds"), F.length("p.text").cast("long").alias("n"))


@query("ag_indexed_counts", f"SELECT media_id, count(*) FILTER (modality = 'transcript') AS transcript, count(*) FILTER (modality = 'ocr') AS ocr FROM ({A.POINTS}) GROUP BY media_id")
def indexed_counts(spark, d):
    return I.indexed_counts(A.load(spark, d, A.POINTS), ("transcript", "ocr"))


_PROBE = """(SELECT p_partkey AS id, CASE p_partkey % 4
 WHEN 0 THEN '{{"streams":[{{"codec_type":"audio","codec_name":"aac","channels":2}},{{"codec_type":"video","codec_name":"h264","width":640,"height":480,"r_frame_rate":"30000/1001"}}],"format":{{"duration":"12.5"}}}}'
 WHEN 1 THEN '{{"streams":[{{"codec_type":"audio","codec_name":"mp3","channels":1}}],"format":{{}}}}'
 WHEN 2 THEN '{{"streams":[{{"codec_type":"video","codec_name":"vp9","width":10,"height":20,"r_frame_rate":"25/0"}}],"format":{{"duration":"x"}}}}'
 ELSE '{{"streams":[]}}' END AS js FROM {part})"""


@query("pr_probe_metadata", f"SELECT id, CASE id % 4 WHEN 0 THEN 12.5::DOUBLE END AS duration_seconds, CASE id % 4 WHEN 0 THEN 'h264' WHEN 1 THEN 'mp3' WHEN 2 THEN 'vp9' END AS codec, CASE id % 4 WHEN 0 THEN round(30000.0 / 1001, 6)::DOUBLE END AS frame_rate, id % 4 IN (0, 1) AS has_audio FROM {_PROBE}")
def probe_metadata(spark, d):
    rows = A.load(spark, d, f"SELECT * FROM {_PROBE}").select("id", I.probe_metadata(F.col("js")).alias("m"))
    return rows.select("id", "m.duration_seconds", "m.codec", F.round("m.frame_rate", 6).alias("frame_rate"), "m.has_audio")
