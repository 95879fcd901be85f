"""Keyed tables: upsert, replace by key, and the property graph derived from shots.

Each operator returns the table's new content; write_replaced() stores it. A replay of the same
batch changes nothing. An empty replacement still clears its keys, which a dynamic partition
overwrite alone would not do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .commit_log import CommitLog


def greatest(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, also for null: the greatest by the other columns."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*others)).alias("upsert_row")).select(key, "upsert_row.*") if others else rows.distinct()


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of updates win over rows of base with an equal key. Of several updates of a key one counts, the greatest by their other columns. Rows of base that no update replaces stay as they are, so a base that repeats keys goes through greatest() first."""
    return base.join(updates.select(key), key, "left_anti").unionByName(greatest(updates, key), allowMissingColumns=True)


def replace_by_key(base: DataFrame, updates: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows of the given keys are replaced; keys without new rows are cleared."""
    return base.join(keys.select(key).distinct(), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def wrong_points(points: DataFrame, dimensions: dict[str, int]) -> DataFrame:
    """Points whose vector doesn't have its collection's dimension, or of an unknown collection."""
    known = F.create_map(*(x for k, v in dimensions.items() for x in (F.lit(k), F.lit(v))))
    return points.where(~(F.size("vector") == F.coalesce(F.try_element_at(known, F.col("collection")), F.lit(-1))))


def next_edges(shots: DataFrame) -> DataFrame:
    """(src, dst) of consecutive shots of a media by index."""
    own = Window.partitionBy("media_id").orderBy("shot_index", "shot_id")
    return shots.select(F.col("shot_id").alias("src"), F.lead("shot_id").over(own).alias("dst")).where("dst is not null")


def belongs_to(shots: DataFrame, videos: DataFrame) -> DataFrame:
    return shots.join(videos.select("media_id"), "media_id").select(F.col("shot_id").alias("src"), F.col("media_id").alias("dst"))


def without_media(shots: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shots and NEXT edges after deleting media: edges go with their source's media."""
    dead = shots.join(gone, "media_id", "left_semi").select(F.col("shot_id").alias("src"))
    return shots.join(gone, "media_id", "left_anti"), edges.join(dead, "src", "left_anti")


def in_order(parts: Column) -> Column:
    return F.array_join(F.sort_array(parts)["text"], " ")


def healthy(spark) -> DataFrame:
    """One row (ok) if the store's engine answers."""
    return spark.range(1).select(F.lit(1).alias("ok"))


def write_replaced(content: DataFrame, path: str, partition: str) -> int:
    """Stores the whole content in a folder of its own and then makes it the next version, which one writer alone can take; readers see the last whole write at any time. For tables of which a write changes few keys, see keyed_table."""
    import uuid

    name = uuid.uuid4().hex
    content.write.partitionBy(partition).parquet(f"{path}/v={name}")
    return CommitLog(content.sparkSession, f"{path}/_log").append({"id": name})


def read_replaced(spark, path: str, version: int | None = None) -> DataFrame:
    """The last content, or that of an earlier version which is still there."""
    entries = [e for e in CommitLog(spark, f"{path}/_log").entries() if version is None or e["version"] == version]
    return spark.read.parquet(f"{path}/v={entries[-1]['id']}")


def remove_replaced(spark, path: str, keep: int = 2, older_seconds: float = 86_400) -> int:
    """Deletes the contents of all but the last versions, and of writes that never became one, once they are old enough for no reader or writer to be at them; returns how many."""
    import time

    log, removed = CommitLog(spark, f"{path}/_log"), 0
    kept = {e["id"] for e in log.entries()[-keep:]}
    fs, top = log.files(path)
    for s in fs.listStatus(top):
        name = s.getPath().getName()
        if name.startswith("v=") and name[2:] not in kept and time.time() - s.getModificationTime() / 1000 >= older_seconds:
            fs.delete(s.getPath(), True)
            removed += 1
    return removed
