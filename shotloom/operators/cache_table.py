"""A cache as a bucketed table: a bulk lookup shuffles the requests alone, and those that a bit filter rules out aren't looked up.

The table is hashed by key when it is written, so joins on the key read it in place. The filter holds a bit for
each hash of a key, in pieces of 32,768 bits that are rows of a table, about BITS bits a key; a request whose bit isn't set is a
miss. Nothing is collected, and the filter is as large as the cache allows, joined by piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import new_path

#: Bits of the filter for each key; one in so many absent keys is looked up in vain.
BITS = 16
#: Bits of one piece, those of Spark's bitmaps.
PIECE = 32_768


class CacheTable:
    """Entries by key, one row a key, in a table of its own of the session's catalog."""

    def __init__(self, spark: SparkSession, name: str, bits: int):
        self.spark, self.name, self.bits = spark, name, bits

    @classmethod
    def write(cls, entries: DataFrame, buckets: int = 64, name: str | None = None) -> CacheTable:
        """Stores entries (key and other columns). Entries without a key are left out; of several with one key an arbitrary one is found, so make them unique first."""
        spark = entries.sparkSession
        name = name or f"cache_{uuid.uuid4().hex}"
        rows = entries.where("key IS NOT NULL")
        rows.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", new_path(spark, "cache")).saveAsTable(name)
        own = spark.table(name)
        bits = PIECE * max(1, -(-own.count() * BITS // PIECE))
        pieces = own.select(cls._place(bits).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
        pieces.write.option("path", new_path(spark, "cache-filter")).saveAsTable(f"{name}_filter")
        return cls(spark, name, bits)

    @staticmethod
    def _place(bits: int, key: str = "key"):
        return F.pmod(F.xxhash64(key), F.lit(bits))

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def maybe(self, requests: DataFrame, key: str = "key") -> DataFrame:
        """requests with may_hold: false if the cache surely doesn't hold their key. A null key is never held."""
        place = self._place(self.bits, key)
        pieces = self.spark.table(f"{self.name}_filter").withColumnsRenamed({"piece": "ct_piece", "bitmap": "ct_bitmap"})
        placed = requests.withColumns({"ct_no": F.bitmap_bucket_number(place), "ct_bit": F.bitmap_bit_position(place)})
        byte = F.conv(F.hex(F.substring("ct_bitmap", F.floor(F.col("ct_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.floor(byte / F.pow(F.lit(2.0), F.pmod("ct_bit", F.lit(8)))) % 2 == 1
        found = placed.join(pieces, F.col("ct_no") == F.col("ct_piece"), "left").withColumn("may_hold", F.coalesce(F.col(key).isNotNull() & hit, F.lit(False)))
        return found.drop("ct_no", "ct_bit", "ct_piece", "ct_bitmap")

    def get(self, requests: DataFrame, key: str = "key") -> DataFrame:
        """requests, each with the entry of its key as the struct entry, null where there is none. Requests are hashed by key to the table's buckets; the table isn't moved."""
        asked = self.maybe(requests, key)
        others = [c for c in self.entries().columns if c != "key"]
        held = self.entries().select(F.col("key").alias("ct_key"), F.struct(*others).alias("entry"))
        found = asked.where("may_hold").join(held.hint("merge"), F.col(key) == F.col("ct_key"), "left").drop("ct_key", "may_hold")
        kind = found.schema["entry"].dataType
        return found.unionByName(asked.where("NOT may_hold").drop("may_hold").withColumn("entry", F.lit(None).cast(kind)))

    def drop(self) -> None:
        for t in (self.name, f"{self.name}_filter"):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")


def second_chance(requests: DataFrame, current: CacheTable, legacy: CacheTable) -> DataFrame:
    """requests (key, legacy_key) with their outcome: hit, corrupt, legacy (promoted to the new key) or miss, as cache.lookup() tells it. Only keys that the current cache lacks go to the legacy one."""
    first = current.get(requests, "key").withColumnRenamed("entry", "current_entry")
    known = first.where("current_entry IS NOT NULL").withColumn("outcome", F.when(F.col("current_entry.valid"), "hit").otherwise("corrupt"))
    rest = legacy.get(first.where("current_entry IS NULL"), "legacy_key").withColumn("outcome", F.when(F.col("entry.valid"), "legacy").otherwise("miss"))
    return known.drop("current_entry").unionByName(rest.drop("current_entry", "entry"))
