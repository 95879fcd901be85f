"""File sources and sinks: object bytes, listings, image headers, probes, JSON messages, versioned writes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def objects(spark: SparkSession, path: str, pattern: str | None = None, with_bytes: bool = True) -> DataFrame:
    """(path, length, modificationTime, content, content_hash) of files; without bytes, the content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path)
    return rows.withColumn("content_hash", F.sha2("content", 256)) if with_bytes else rows.drop("content")


def exists(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds found to keys (path)."""
    return keys.join(listing.select("path", F.lit(True).alias("found")), "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _size(data: bytes):
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + length
    return None, None


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from the header of PNG, GIF and JPEG bytes; null for other bytes."""
    return pd.DataFrame([_size(bytes(x)) if x is not None else (None, None) for x in content], columns=["width", "height"]).astype("Int64")


def variant_height(width, height, most: int):
    """Height of a variant of at most so many pixels width."""
    return F.when(width > most, F.greatest(F.lit(1), F.round(height * most / width))).otherwise(height).cast("long")


def font_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("family string, weight string, italic boolean, file string").json(path)


def font_files(rows: DataFrame, catalog: DataFrame, default: str) -> DataFrame:
    """rows (family, weight) with file; families that the catalog lacks take the default family's file of that weight. The catalog has as many rows as there are fonts."""
    own = catalog.select("family", "weight", "file").dropDuplicates(["family", "weight"])
    other = own.where(F.col("family") == default).select("weight", F.col("file").alias("fallback"))
    return rows.join(own, ["family", "weight"], "left").join(other, "weight", "left").withColumn("file", F.coalesce("file", "fallback")).drop("fallback")


def put_objects(files: DataFrame, path: str) -> None:
    """Writes (key, content) as a table of blobs, which is what an object store of many small objects should be on a cluster."""
    files.select("key", "content").write.mode("append").parquet(path)


def publish(events: DataFrame, path: str) -> None:
    """Events as compact JSON lines."""
    events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
