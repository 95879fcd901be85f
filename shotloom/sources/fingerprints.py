"""Content fingerprints of files that may change while they are read, and groups of positions by content.

A file's signature is its length and time of change. It is listed, hashed and listed again; a file whose
signature changed meanwhile is read once more, and if it changes again it counts as unstable and is grouped by its
path, so that nothing is ever cached under a hash of bytes that were in motion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import written

SIGNATURE = ("length", "modificationTime")


def signatures(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of the files below path as they are now; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", *SIGNATURE)


def _hashed(spark: SparkSession, path: str, pattern: str | None, since=None) -> DataFrame:
    """(path, signature, content_hash, whole), written: one reading of the files, of those changed since a time if one is given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path)
    if since is not None:
        rows = rows.where(F.col("modificationTime") >= F.lit(since))  # pushed down: other files aren't opened
    return written(rows.select("path", *SIGNATURE, F.sha2("content", 256).alias("content_hash"), (F.octet_length("content") == F.col("length")).alias("whole")), "fingerprints")


def _settled(read: DataFrame, now: DataFrame) -> DataFrame:
    """read with stable: the signature is still the same and all bytes were there."""
    after = now.select(F.col("path").alias("now_path"), *(F.col(c).alias(f"now_{c}") for c in SIGNATURE))
    same = F.col("now_path").isNotNull() & F.col("whole")
    for c in SIGNATURE:
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    found = read.join(after, F.col("path") == F.col("now_path"), "left")
    return found.select("path", *(F.coalesce(f"now_{c}", c).alias(c) for c in SIGNATURE), "content_hash", same.alias("stable"))


def fingerprints(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime, content_hash, stable) of every file below path, written. An empty folder gives no rows, nor do empty files, which Spark's file sources leave out."""
    first = written(_settled(_hashed(spark, path, pattern), signatures(spark, path, pattern)), "fingerprints")
    moving = first.where("NOT stable")
    since = moving.agg(F.min("modificationTime")).first()[0]
    if since is None:
        return first
    again = _settled(_hashed(spark, path, pattern, since), signatures(spark, path, pattern)).join(moving.select("path"), "path", "left_semi")
    return written(first.join(again.select("path"), "path", "left_anti").unionByName(again), "fingerprints")


def content_keys(positions: DataFrame, prints: DataFrame) -> DataFrame:
    """(pos, path, content_key) of positions (pos, path): content:<hash> for stable files, unstable:<path> for others; null for a path that isn't there."""
    key = F.when(F.col("stable"), F.concat(F.lit("content:"), "content_hash")).when(~F.col("stable"), F.concat(F.lit("unstable:"), "path"))
    return positions.join(prints.select("path", "content_hash", "stable"), "path", "left").select("pos", "path", key.alias("content_key"))


def content_groups(keyed: DataFrame) -> DataFrame:
    """(content_key, representative, first_pos, n): what has to be processed, each content once, by its first position. Minima and counts alone, so a content in a third of all positions is no burden."""
    return keyed.where("content_key IS NOT NULL").groupBy("content_key").agg(F.min_by("path", F.struct("pos", "path")).alias("representative"), F.min("pos").alias("first_pos"), F.count("*").alias("n"))


def expanded(keyed: DataFrame, results: DataFrame) -> DataFrame:
    """Results by content_key back to every position."""
    return keyed.select("pos", "content_key").join(results, "content_key", "left")


def unchanged(keyed: DataFrame, prints: DataFrame, now: DataFrame) -> DataFrame:
    """(content_key, unchanged): whether every file of a group still has the signature that it was hashed with. Ask before a cached result is used and before one is stored."""
    own = keyed.join(prints.select("path", *SIGNATURE), "path").select("path", "content_key", *SIGNATURE).distinct()
    after = now.select("path", *(F.col(c).alias(f"now_{c}") for c in SIGNATURE))
    same = F.lit(True)
    for c in SIGNATURE:
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    return own.join(after, "path", "left").groupBy("content_key").agg(F.bool_and(same).alias("unchanged"))
