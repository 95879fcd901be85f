"""Interval joins by time bucket: an equi-join with a residual, never a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import fresh


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket_seconds: float) -> DataFrame:
    """Pairs with max(starts) < min(ends) under an equal key; columns of right get the prefix r_.

    Each interval goes to every bucket it touches; a pair is kept in the bucket of its common start
    alone, so there are no duplicates. Null bounds never overlap.
    """
    bucket = fresh(left, fresh(right, "bucket"))

    def cut(df):
        to = F.floor(F.greatest("end_seconds", "start_seconds") / bucket_seconds)
        return df.where("start_seconds is not null and end_seconds is not null").withColumn(bucket, F.explode(F.sequence(F.floor(F.col("start_seconds") / bucket_seconds), to)))

    own, other = cut(left), cut(right)
    other = other.select(*(F.col(c).alias(f"r_{c}") for c in other.columns))
    start, end = F.greatest("start_seconds", "r_start_seconds"), F.least("end_seconds", "r_end_seconds")
    pairs = own.join(other, (F.col(key) == F.col(f"r_{key}")) & (F.col(bucket) == F.col(f"r_{bucket}")) & (start < end) & (F.floor(start / bucket_seconds) == F.col(bucket)))
    return pairs.drop(bucket, f"r_{bucket}")


def bucket_of(*sides: DataFrame) -> float:
    """A bucket that nine of ten intervals of either side fit into: each then goes to two buckets or fewer, and a bucket holds few of them."""
    lengths = [s.agg(F.percentile_approx(F.col("end_seconds") - F.col("start_seconds"), 0.9)).first()[0] for s in sides]
    return max([float(x) for x in lengths if x is not None and x > 0], default=1.0)


def align_transcript(shots: DataFrame, segments: DataFrame, bucket_seconds: float | None = None) -> DataFrame:
    """Text and number of the segments over each shot, in segment order; shots without one keep '' and 0. The bucket comes from the lengths unless it is given."""
    bucket_seconds = bucket_seconds or bucket_of(shots, segments)
    pairs = overlap_join(shots.select("media_id", "shot_id", "start_seconds", "end_seconds"), segments, "media_id", bucket_seconds)
    texts = pairs.groupBy("shot_id").agg(F.sort_array(F.collect_list(F.struct("r_pos", "r_text"))).alias("parts"), F.count("r_pos").alias("segment_count"))
    texts = texts.select("shot_id", F.trim(F.array_join("parts.r_text", " ")).alias("text"), "segment_count")
    return shots.select("media_id", "shot_id").join(texts, "shot_id", "left").select("media_id", "shot_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("segment_count", F.lit(0)).alias("segment_count"))


def frames_of(items: DataFrame, fps: int) -> DataFrame:
    """A row for each frame in which an item is active, on the half-open [start, start + duration)."""
    first = F.ceil(F.col("timeline_start") * fps)
    last = F.ceil((F.col("timeline_start") + F.col("duration")) * fps) - 1
    return items.where(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))
