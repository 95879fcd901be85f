"""Manifest upgrades, item validation, request identity, and what is left in the stores after a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cache import within_scope
from .manifest import upgraded_stack_order


def upgrade(items: DataFrame) -> DataFrame:
    """Items of versions 1 and 2 as version 3: fades and style are reset, sound gets its owner; version 1 also gets its stack order. Version 3 stays."""
    order = upgraded_stack_order(items.where("version = 1")).withColumnRenamed("stack_order", "__n")
    old, sound, text = F.col("version") < 3, F.col("item_type") == "audio", F.col("item_type") == "text"
    rows = items.join(order, ["document_id", "item_id"], "left")
    return rows.withColumns({
        "stack_order": F.coalesce("__n", "stack_order").cast("long"),
        "fade_in": F.when(old & ~sound, 0.0).otherwise(F.col("fade_in")), "fade_out": F.when(old & ~sound, 0.0).otherwise(F.col("fade_out")),
        "source_owner": F.when(old & sound, "audio-item"), "preset": F.when(old & ~sound & ~text, "Original"),
    }).drop("__n")


def agreed(a: Column, b: Column) -> Column:
    """One value under two names: null if they differ."""
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(None)).otherwise(F.coalesce(a, b))


def request_hash(media_ids: Column, query: Column, top_k: Column) -> Column:
    """Hash of the canonical JSON of a request: sorted keys, sorted distinct ids, no spaces."""
    media = F.array_sort(F.array_distinct(F.transform(media_ids, lambda x: F.lower(F.trim(x)))))
    return F.sha2(F.to_json(F.struct(media.alias("media"), query.alias("query"), top_k.alias("top_k"))), 256)


def item_error() -> Column:
    """The first broken range of a visual item's fields, or null."""
    low = lambda c: F.coalesce(F.col(c), F.lit(-1.0)) < 0
    return (
        F.when(F.coalesce("duration", F.lit(0.0)) <= 0, "duration must be positive")
        .when(low("timeline_start"), "start must be non-negative")
        .when((F.col("item_type") == "video") & low("source_in"), "source_in must be non-negative")
        .when((F.col("item_type") == "video") & (F.coalesce("source_out", F.lit(0.0)) <= 0), "source_out must be positive")
        .when(~F.coalesce("opacity", F.lit(1.0)).between(0, 1), "opacity must be between 0 and 1")
    )


def cached_outcome() -> Column:
    """What a stored result is worth: miss, corrupt, outside scope, or hit. All but hits are computed again; complete results are then stored."""
    return F.when(~F.col("stored"), "miss").when(~F.col("valid"), "corrupt").when(~within_scope(F.col("ids"), F.col("trusted")), "outside scope").otherwise("hit")


def after_stage(kind: str, state: Column, clear_on_failure: bool = False) -> Column:
    """What happens to a media's points of a kind after its stage ended ok, failed or without sound.

    A failed transcript, OCR or video stage leaves the former points; failed audio clears its own.
    clear_on_failure clears all.
    """
    failed = "cleared" if clear_on_failure or kind == "audio" else "kept"
    quiet = "cleared" if kind in ("transcript", "audio") else "replaced"
    return F.when(state == "ok", "replaced").when(state == "failed", failed).when(state == "no_audio", quiet)
