"""Render manifests from exploded timelines: stacking, audio ownership, validation, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round3

#: Item types that a manifest takes. Fixed values.
MEDIA_TYPES = ("video", "image", "overlay", "audio")
VISUAL_TYPES = ("video", "image", "overlay")


def stack_order(items: DataFrame) -> DataFrame:
    """(document_id, item_id, stack_order) of visible, non-audio items, dense from 0; of equal ids the last counts.

    Video and image items of video tracks come first, upper tracks last; the rest follow by layer.
    """
    own = items.where(~F.col("hidden") & (F.col("item_type") != "audio"))
    base = (F.col("track_kind") == "video") & F.col("item_type").isin("video", "image")
    keyed = own.withColumns({"phase": F.when(base, 0).otherwise(1), "p": F.when(base, -F.col("track_index")).otherwise(F.col("layer_order")), "s": F.when(base, F.col("layer_order")).otherwise(F.col("track_index"))})
    order = Window.partitionBy("document_id").orderBy("phase", "p", "s", "item_index", "item_id")
    return keyed.withColumn("n", F.row_number().over(order) - 1).groupBy("document_id", "item_id").agg(F.max("n").alias("stack_order"))


def upgraded_stack_order(items: DataFrame) -> DataFrame:
    """Stack order of the first manifest version: visual and text items by start, layer and id; visual first among equals."""
    own = items.where(F.col("item_type") != "audio").withColumn("kind_ord", (F.col("item_type") == "text").cast("int"))
    order = Window.partitionBy("document_id").orderBy("timeline_start", "layer_order", "item_id", "kind_ord", "track_index", "item_index")
    return own.select("document_id", "item_id", (F.row_number().over(order) - 1).alias("stack_order"))


def usable_items(items: DataFrame) -> DataFrame:
    """Items that reach the manifest: hidden tracks go, muted audio tracks go, muted audio items go, unknown types go."""
    return items.where(~F.col("hidden") & ~((F.col("track_kind") == "audio") & F.col("muted")) & F.col("item_type").isin(*MEDIA_TYPES, "text") & ~((F.col("item_type") == "audio") & F.col("item_muted")))


def audio_items(items: DataFrame) -> DataFrame:
    """Explicit audio items, and the sound of video items whose linked group has no audio item on a visible track.

    Muted tracks and items still own their group. A video on a muted track keeps its picture alone.
    """
    used = usable_items(items)
    owners = items.where(~F.col("hidden") & (F.col("item_type") == "audio") & (F.coalesce("linked_group", F.lit("")) != "")).select("document_id", "linked_group").distinct()
    videos = used.where((F.col("item_type") == "video") & ~F.col("muted"))
    sound = videos.join(owners, ["document_id", "linked_group"], "left_anti")
    return used.where(F.col("item_type") == "audio").withColumn("source_owner", F.lit("audio-item")).unionByName(sound.withColumn("source_owner", F.lit("embedded-video")))


def with_media(items: DataFrame, media: DataFrame) -> DataFrame:
    """Items with their media source; error names an unresolved or undersized one."""
    own = media.select("media_id", "kind", "name", "object_key", "width", "height", F.lit(True).alias("found"))
    both = items.where(F.col("item_type").isin(*MEDIA_TYPES)).join(own, "media_id", "left")
    flat = (F.col("item_type") != "audio") & ((F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0))
    return both.withColumn("error", F.when(F.col("found").isNull(), "unresolved media").when(F.trim("object_key") == "", "missing key").when(flat, "missing dimensions"))


def display_name(name: Column, key: Column, media_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(F.element_at(F.split(key, "/"), -1), F.lit("")), media_id)


def media_kind(kind: Column) -> Column:
    own = F.lower(kind)
    return F.when(own.isin("video", "audio", "image"), own).when(own.rlike(r"\.video\z") | (own == "0"), "video").when(own.rlike(r"\.audio\z") | (own == "1"), "audio").when(own.rlike(r"\.image\z") | (own == "2"), "image").otherwise(own)


def extension(kind: Column) -> Column:
    own = media_kind(kind)
    return F.when(own == "image", ".png").when(own == "audio", ".wav").otherwise(".mp4")


def in_audio_order(audio: DataFrame) -> DataFrame:
    """audio items with their place from 1: by start, then by track, id and place in the track."""
    own = Window.partitionBy("document_id").orderBy("timeline_start", "track_index", "item_id", "item_index")
    return audio.withColumn("pos", F.row_number().over(own).cast("long"))


def numbered_items(tracks: DataFrame) -> DataFrame:
    """(document_id, track_id, item_index, item) of tracks with an array of items, numbered by their place."""
    return tracks.select("document_id", "track_id", F.posexplode("items").alias("item_index", "item"))


def audio_seconds(item_duration: Column, source_in: Column, source_out: Column, speed: Column) -> Column:
    """What an item plays: its duration, or less if its source ends before, at least a millisecond."""
    return F.least(item_duration, F.greatest(F.lit(0.001), (source_out - source_in) / speed))


def durations(items: DataFrame) -> DataFrame:
    return items.groupBy("document_id").agg(round3(F.greatest(F.lit(0.1), F.max(F.col("timeline_start") + F.col("duration")))).alias("duration_seconds"))


def resolution(value: Column, width: Column, height: Column) -> Column:
    edge = F.least(width, height)
    by_size = F.when(edge == 720, "720p").when(edge == 1080, "1080p").when(edge == 2160, "2160p").otherwise("current")
    named = F.when(value == "1280x720", "720p").when(value == "1920x1080", "1080p").when(value == "3840x2160", "2160p").when(value.isin("720p", "1080p", "2160p", "current"), value)
    return F.coalesce(named, by_size)


def settings(job: dict[str, Column], document: dict[str, Column]) -> Column:
    """Export size, rate and resolution: the job's, else the document's, else the default; 0 counts as missing."""
    pick = lambda k, d: F.coalesce(F.nullif(job[k], F.lit(0)), F.nullif(document[k], F.lit(0)), F.lit(d))
    w, h = pick("width", 1920), pick("height", 1080)
    lw, lh = F.coalesce(F.nullif(document["width"], F.lit(0)), F.lit(1920)), F.coalesce(F.nullif(document["height"], F.lit(0)), F.lit(1080))
    bad = F.when((w <= 0) | (h <= 0) | (w % 2 != 0) | (h % 2 != 0), "size not even").when(F.abs(w * lh - h * lw) > F.greatest(lw, lh), "aspect ratio")
    return F.struct(w.alias("width"), h.alias("height"), pick("frame_rate", 30).alias("frame_rate"), resolution(job["resolution"], w, h).alias("resolution"), bad.alias("error"))


def first_error(items: DataFrame, error: Column) -> DataFrame:
    """The first item's error in document order, for documents that have one."""
    return items.withColumn("__e", error).where("__e is not null").groupBy("document_id").agg(F.min_by(F.struct("item_id", F.col("__e").alias("error")), F.struct("track_index", "item_index")).alias("x")).select("document_id", "x.*")
