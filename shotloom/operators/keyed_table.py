"""A keyed table with merge-on-read: replacing a key's rows writes that key's bucket and nothing else.

    <path>/data/<id>/rows/kt_bucket=<b>   rows of one write
    <path>/data/<id>/gone/kt_bucket=<b>   keys whose earlier rows that write replaces or clears
    <path>/log/<version>               the write that became this version, one line of JSON

A write stores its files first and then makes its log entry, whose number nobody else may have
taken. Files without an entry are never read, so a job that fails, also by a row that doesn't pass the
check, leaves the former content. Readers take the rows of all live entries and drop those of
versions before the last removal of their key. compact() merges buckets into new base files; from then
on earlier entries aren't read for these buckets.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commit_log import CommitLog


@dataclass
class Entry:
    version: int
    id: str
    kind: str
    #: Content of versions up to this one is merged into a base entry.
    upto: int
    buckets: list[int]
    batch: str | None = None
    live: set[int] = field(default_factory=set)


class KeyedTable:
    """Rows of schema (a DDL string) under the column key; numbers of buckets can't change later."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self.log = CommitLog(spark, f"{path}/log")
        self.empty = spark.createDataFrame([], schema)
        if any(c.lower().startswith("kt_") for c in self.empty.columns):
            raise ValueError("names that begin with kt_ are the table's own")

    # ------------------------------------------------------------ the log

    def entries(self) -> list[Entry]:
        """All log entries in order, with the buckets for which each still counts."""
        found = [Entry(**e) for e in self.log.entries()]
        merged: dict[int, tuple[int, int]] = {}
        for e in found:
            if e.kind == "base":
                for b in e.buckets:
                    merged[b] = max(merged.get(b, (0, 0)), (e.upto, e.version))
        for e in found:
            for b in e.buckets:
                upto, base = merged.get(b, (0, 0))
                if e.version == base or (e.kind == "delta" and e.version > upto):
                    e.live.add(b)
        return found

    def _commit(self, id_: str, kind: str, buckets: list[int], upto: int = 0, batch: str | None = None) -> int:
        return self.log.append({"id": id_, "kind": kind, "upto": upto, "buckets": buckets, "batch": batch})

    # ------------------------------------------------------------ writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _store(self, df: DataFrame, to: str) -> None:
        # rebalancing splits a bucket of very many rows over several tasks
        df.withColumn("kt_bucket", self._bucket()).hint("rebalance", "kt_bucket").write.partitionBy("kt_bucket").parquet(to)

    def _buckets_in(self, *paths: str) -> list[int]:
        found = set()
        for p in paths:
            fs, own = self.log.files(p)
            if fs.exists(own):
                found |= {int(s.getPath().getName().removeprefix("kt_bucket=")) for s in fs.listStatus(own) if s.getPath().getName().startswith("kt_bucket=")}
        return sorted(found)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, check: Column | None = None, batch: str | None = None) -> int:
        """Replaces all rows of the keys by rows and returns the version. Without keys, those of rows are replaced (an upsert); keys without rows are cleared.

        check: null for a row that may be written, else what is wrong with it; one wrong row in any
        task fails the job and leaves the former content. A batch name that was committed before
        changes nothing. Rows with keys that aren't among the given ones are added to what is there. Rows without a key can't be
        replaced or looked up, but are kept. Extra columns are left out.
        """
        done = [e for e in self.entries() if batch is not None and e.batch == batch]
        if done:
            return done[0].version
        id_ = uuid.uuid4().hex
        at = f"{self.path}/data/{id_}"
        if check is not None:
            rows = rows.where(F.when(check.isNotNull(), F.raise_error(check)).cast("boolean").isNull())
        rows = rows.select(*self.empty.columns)
        self._store(rows, f"{at}/rows")
        gone = keys.select(self.key) if keys is not None else self.spark.read.schema(f"{self.schema}, kt_bucket int").parquet(f"{at}/rows").select(self.key)
        self._store(gone.where(F.col(self.key).isNotNull()).distinct(), f"{at}/gone")
        return self._commit(id_, "delta", self._buckets_in(f"{at}/rows", f"{at}/gone"), batch=batch)

    def clear(self, keys: DataFrame) -> int:
        return self.replace(self.empty, keys)

    # ------------------------------------------------------------ reading

    def _read(self, entry: Entry, what: str, columns: str, live: set[int]) -> DataFrame | None:
        at = f"{self.path}/data/{entry.id}/{what}"
        if not live & set(self._buckets_in(at)):
            return None
        rows = self.spark.read.schema(f"{columns}, kt_bucket int").parquet(at).where(F.col("kt_bucket").isin(sorted(live)))
        return rows.withColumn("kt_version", F.lit(entry.version).cast("long"))

    def _union(self, parts: list[DataFrame | None]) -> DataFrame | None:
        out = None
        for p in parts:
            out = p if out is None else out if p is None else out.unionByName(p)
        return out

    def content(self, keys: DataFrame | None = None, buckets: set[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows as of the last version or of an earlier one that isn't compacted away. keys (a bounded table): their rows alone, and only their buckets are read."""
        if keys is not None:
            keys = keys.select(self.key).distinct()
            buckets = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # as many as there are buckets at most
        entries = [e for e in self.entries() if version is None or e.version <= version]
        want = lambda e: e.live if buckets is None else e.live & buckets
        rows = self._union([self._read(e, "rows", self.schema, want(e)) for e in entries])
        if rows is None:
            return self.empty
        kind = self.empty.schema[self.key].dataType.simpleString()
        gone = self._union([self._read(e, "gone", f"`{self.key}` {kind}", want(e)) for e in entries if e.kind == "delta"])
        if gone is not None:
            last = gone.groupBy(F.col(self.key).alias("kt_key"), F.col("kt_bucket").alias("kt_at")).agg(F.max("kt_version").alias("kt_gone"))
            rows = rows.join(last, (F.col("kt_bucket") == F.col("kt_at")) & (F.col(self.key) == F.col("kt_key")), "left")
            rows = rows.where("kt_gone IS NULL OR kt_version >= kt_gone")
        rows = rows.select(*self.empty.columns)
        return rows.join(keys, self.key, "left_semi") if keys is not None else rows

    # ------------------------------------------------------------ upkeep

    def compact(self, buckets: set[int] | None = None) -> int | None:
        """Merges the buckets (all that have deltas, if none are given) into base files; None if there is nothing to merge. Writes that are committed meanwhile stay."""
        entries = self.entries()
        mine = {b for e in entries if e.kind == "delta" for b in e.live if buckets is None or b in buckets}
        if not mine:
            return None
        upto = max(e.version for e in entries)
        id_ = uuid.uuid4().hex
        self._store(self.content(buckets=mine, version=upto), f"{self.path}/data/{id_}/rows")
        return self._commit(id_, "base", sorted(mine), upto)

    def vacuum(self, older_seconds: float = 86_400) -> int:
        """Removes files that no live bucket needs and that are old enough for no reader or writer to be at them; returns how many writes went."""
        needed, removed = {e.id for e in self.entries() if e.live}, 0
        fs, data = self.log.files(f"{self.path}/data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in needed and time.time() - s.getModificationTime() / 1000 >= older_seconds:
                fs.delete(s.getPath(), True)
                removed += 1
        return removed


def wrong_vector(dimensions: dict[str, int], collection: str = "collection", vector: str = "vector") -> Column:
    """What is wrong with a point: an unknown collection or a vector of another dimension; null if nothing."""
    known = F.create_map(*(x for k, v in dimensions.items() for x in (F.lit(k), F.lit(v))))
    want = F.try_element_at(known, F.coalesce(F.col(collection), F.lit("")))
    size = F.coalesce(F.size(vector), F.lit(-1))
    return F.when(want.isNull(), F.concat(F.lit("unknown collection "), F.coalesce(F.col(collection), F.lit("null")))).when(
        size != want, F.concat(F.lit("vector of dimension "), size.cast("string"), F.lit(" in "), F.col(collection))
    )


def write_points(table: KeyedTable, points: DataFrame, media_ids: DataFrame, dimensions: dict[str, int], batch: str | None = None) -> int:
    """Replaces the points of the media in one transaction: all of them are checked by the tasks that write them, and nothing is visible before all are stored."""
    return table.replace(points, media_ids, wrong_vector(dimensions), batch)
