"""The relational side of media ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import collapse_space

MIN_CONFIDENCE = 0.3


def prefer(probed: Column, requested: Column, empty) -> Column:
    """The probed value unless it is null or empty (0 or ''), then the requested one."""
    return F.coalesce(F.nullif(probed, F.lit(empty)), requested)


def shot_rows(detected: DataFrame) -> DataFrame:
    return detected.withColumn("duration_seconds", F.greatest(F.lit(0.0), F.col("end_seconds") - F.col("start_seconds")))


def with_fallback_shot(media: DataFrame, shots: DataFrame) -> DataFrame:
    """Media without a shot get one over their whole duration."""
    both = media.select("media_id", "duration_seconds").join(shots.select("media_id", "shot_index", "start_seconds", "end_seconds"), "media_id", "left")
    return both.select("media_id", F.coalesce("shot_index", F.lit(0)).alias("shot_index"), F.coalesce("start_seconds", F.lit(0.0)).alias("start_seconds"), F.coalesce("end_seconds", F.greatest(F.lit(0.0), F.coalesce("duration_seconds", F.lit(0.0)))).alias("end_seconds"))


def midpoint(start: Column, duration: Column) -> Column:
    return F.greatest(F.lit(0.0), start + duration / 2)


def kept_blocks(blocks: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Blocks of enough confidence with a text; NaN confidence passes, null doesn't."""
    return blocks.where(~(F.col("confidence") < least) & (collapse_space(F.col("text")) != ""))


def ocr_by_frame(blocks: DataFrame, frames: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Text in block order, number and mean confidence of the kept blocks; frames without one have '', 0 and null."""
    kept = kept_blocks(blocks, least).groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.trim("text").alias("text")))).alias("parts"), F.count("*").alias("block_count"), F.avg("confidence").alias("mean_confidence"))
    kept = kept.select("frame_id", F.array_join("parts.text", " ").alias("text"), "block_count", "mean_confidence")
    return frames.join(kept, "frame_id", "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("block_count", F.coalesce("block_count", F.lit(0)))


def ocr_by_media(frames: DataFrame) -> DataFrame:
    """Blocks summed, unweighted mean of the frames' means."""
    return frames.groupBy("media_no").agg(F.sum("block_count").alias("block_count"), F.avg("mean_confidence").alias("mean_confidence"), F.count_if(F.col("text") != "").alias("text_frames"))


def transcript_by_media(segments: DataFrame) -> DataFrame:
    """Text of the non-blank segments in order; all segments are counted."""
    parts = F.sort_array(F.collect_list(F.when(collapse_space(F.col("text")) != "", F.struct("pos", F.trim("text").alias("text")))))
    return segments.groupBy("media_id").agg(F.sha2(F.array_join(parts["text"], " "), 256).alias("text_hash"), F.count("*").alias("segment_count"))


def shot_payload(modality: str) -> Column:
    return F.struct(F.concat_ws(":", "shot_id", F.lit(modality)).alias("pointId"), F.col("shot_id").alias("shotId"), F.col("media_id").alias("mediaId"), F.lit(modality).alias("modality"), F.col("start_seconds").alias("startSeconds"), F.col("end_seconds").alias("endSeconds"), F.col("text"))


def media_payload(kind: str) -> Column:
    """A media-level point stands for a pseudo-shot over the whole duration."""
    return F.struct(F.concat_ws(":", "media_id", F.lit(kind)).alias("pointId"), F.concat_ws(":", "media_id", F.lit(kind)).alias("shotId"), F.col("media_id").alias("mediaId"), F.lit(kind).alias("modality"), F.lit(0.0).alias("startSeconds"), F.coalesce("duration_seconds", F.lit(0.0)).alias("endSeconds"), F.col("text"))


def frame_rate(text: Column) -> Column:
    """n/d or n; null for a denominator of 0 or other text."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(text.try_cast("double"))


PROBE = "streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: BIGINT, height: BIGINT, r_frame_rate: STRING, sample_rate: STRING, channels: BIGINT>>, format STRUCT<duration: STRING>"


def first_stream(streams: Column) -> Column:
    """The first video stream, else the first audio stream; null without either."""
    of = lambda kind: F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(1))
    return F.coalesce(of("video"), of("audio"))


def has_audio(streams: Column) -> Column:
    return F.coalesce(F.exists(streams, lambda s: s["codec_type"] == "audio"), F.lit(False))


def indexed_counts(points: DataFrame, modalities: tuple[str, ...]) -> DataFrame:
    """(media_id, a count for each modality); 0 where there is none."""
    return points.groupBy("media_id").agg(*(F.count_if(F.col("modality") == m).alias(m) for m in modalities))


def probe_metadata(json: Column) -> Column:
    """First video stream, else first audio stream, with duration, frame rate and whether there is sound."""
    p = F.from_json(json, PROBE)
    s = first_stream(p["streams"])
    return F.struct(p["format"]["duration"].try_cast("double").alias("duration_seconds"), s["codec_name"].alias("codec"), s["width"].alias("width"), s["height"].alias("height"), frame_rate(s["r_frame_rate"]).alias("frame_rate"), has_audio(p["streams"]).alias("has_audio"))
