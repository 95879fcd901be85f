"""Inverted-file vector index: cells by spherical k-means, a table partitioned by cell, exact re-ranking.

build() fits the cells' centres by Lloyd rounds on a bounded sample (a round is one distributed pass;
the driver holds the centres alone, cells x dimension numbers), then writes every vector to its
cell with its norm and its angle to the centre. search() reads the cells nearest to the query, which
prunes partitions, and ranks their vectors by the exact cosine. Each cell's largest angle bounds the
cosine of everything in it, so search_exact() can tell which further cells might hold a better hit, reads
those too and returns what a scan of all vectors returns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of the sample for each cell.
SAMPLE_PER_CELL = 256
ROUNDS = 8
#: Numbers that the centres may have, 64 MB as float64.
MOST_NUMBERS = 8 << 20
#: Rows of one file of a cell; a cell of very many vectors is written by many tasks.
FILE_ROWS = 250_000
#: Numbers of the vectors and of the queries that a task of search_many holds, 8 and 4 MB as float64, and scores that it computes at a time.
TASK_NUMBERS, ASKED_NUMBERS, SCORES = 1 << 20, 1 << 19, 1 << 20
#: Vectors that are worth a task.
LEAST_ROWS = 1000
#: More than rounding can change a cosine.
SLACK = 1e-11
#: Fixed point of a unit vector's component in sums, so that these don't depend on their order.
FIXED = 1 << 20


def norm_of(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def _rows(column) -> np.ndarray:
    """A list column of vectors of one length, as rows."""
    import pyarrow as pa

    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1) if len(own) else np.zeros((0, 0))


def _units(column) -> np.ndarray:
    """Unit vectors of a list column, as rows; zero vectors stay zero."""
    x = _rows(column)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre of largest cosine, ties to the lower number, and that cosine; a product at a time stays small."""
    at, best = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), 1024):
        dots = x[a : a + 1024] @ centres.T
        at[a : a + 1024] = dots.argmax(1)
        best[a : a + 1024] = dots.max(1)
    return at, best


def _round(sample: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres after one Lloyd round; those without vectors stay."""
    dim = centres.shape[1]

    def sums(batches):
        import pyarrow as pa

        total, n = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch.column(0))
            at, _ = _nearest(x, centres)
            np.add.at(total, at, np.rint(x * FIXED).astype(np.int64))
            n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cell", "total"])

    def added(table):
        import pyarrow as pa

        total = np.array(table.column("total").to_pylist(), np.int64).sum(0)
        return pa.table([table.column("cell").slice(0, 1), pa.array([total.tolist()], pa.list_(pa.int64()))], ["cell", "total"])

    # a cell has one row a task here
    found = sample.select("vector").mapInArrow(sums, "cell int, total array<long>").groupBy("cell").applyInArrow(added, "cell int, total array<long>")
    out = centres.copy()
    for cell, total in found.collect():  # one row a cell
        x = np.array(total, np.float64)
        out[cell] = x / (np.sqrt((x * x).sum()) or 1.0) if len(x) == dim else out[cell]
    return out


def fit(points: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres (cell, position) from up to SAMPLE_PER_CELL vectors a cell, those of least hash of vec_id. At most as many cells as sampled vectors."""
    size = cells * SAMPLE_PER_CELL
    whole = points.where("vector is not null and size(vector) > 0")
    rows = whole.count()
    # the least hashes: a threshold on the hash, so that no sort of all rows is needed
    share = min(1.0, 1.2 * size / max(1, rows))
    order = F.xxhash64("vec_id")
    sample = whole.where(F.abs(order % 1_000_000) < math.ceil(share * 1_000_000)).select("vec_id", "vector")
    first = sample.orderBy(order, "vec_id").limit(cells).select("vector").collect()
    if not first:
        return np.zeros((0, 0))
    dim = len(first[0][0])
    if cells * dim > MOST_NUMBERS:
        raise ValueError(f"{cells} cells of {dim} numbers are more than the driver takes")
    centres = np.array([r[0] for r in first if len(r[0]) == dim], np.float64)
    centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-300)
    centres = np.unique(centres, axis=0)
    for _ in range(rounds):
        centres = _round(sample.where(F.size("vector") == dim), centres)
    return centres


@dataclass
class VectorIndex:
    """A written index. rows and widest: vectors of each cell and the largest angle to its centre."""

    path: str
    centres: np.ndarray
    rows: np.ndarray
    widest: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")

    def nearest_cells(self, query: list[float]) -> np.ndarray:
        """All cells that hold vectors, the nearest first."""
        if not len(self.centres):
            return np.zeros(0, np.int64)
        q = np.array(query, np.float64)
        angle = self.centres @ (q / (np.sqrt(q @ q) or 1.0))
        order = np.argsort(-angle, kind="stable")
        return order[self.rows[order] > 0]

    def best_cosine(self, query: list[float]) -> np.ndarray:
        """For each cell a number that no cosine of its vectors exceeds."""
        if not len(self.centres):
            return np.zeros(0)
        q = np.array(query, np.float64)
        angle = np.arccos(np.clip(self.centres @ (q / (np.sqrt(q @ q) or 1.0)), -1, 1))
        return np.cos(np.maximum(0.0, angle - self.widest)) + 1e-9


def build(points: DataFrame, path: str, cells: int, rounds: int = ROUNDS) -> VectorIndex:
    """Writes the index of points (vec_id, vector, other columns) below path and returns it.

    Points without a vector, with an empty one or with one of another length than the centres are left out, as
    are zero vectors, which have no cosine.
    """
    spark = points.sparkSession
    centres = fit(points, cells, rounds)
    dim = centres.shape[1]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            at, cosine = _nearest(_units(batch.column(0)), centres)
            angle = np.arccos(np.clip(cosine, -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    others = [c for c in points.columns if c != "vector"]
    own = points.where(F.size("vector") == (dim or -1)).select("vector", *others)
    fields = ", ".join(f"`{c}` {t}" for c, t in own.dtypes)
    placed = own.mapInArrow(place, f"{fields}, cell int, angle double") if len(centres) else own.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
    placed = placed.withColumn("norm", norm_of(F.col("vector"))).where("norm > 0")
    files = max(1, points.count() // FILE_ROWS)
    placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(files))).write.partitionBy("cell").parquet(f"{path}/cells")
    rows, widest = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    written = spark.read.parquet(f"{path}/cells") if len(centres) and not placed.isEmpty() else None
    if written is not None:
        for cell, n, angle in written.groupBy("cell").agg(F.count("*"), F.max("angle")).collect():  # one row a cell
            rows[cell], widest[cell] = n, angle
    meta = [(i, c.tolist(), int(rows[i]), float(widest[i])) for i, c in enumerate(centres)]
    spark.createDataFrame(meta, "cell int, centre array<double>, n long, widest double").coalesce(1).write.parquet(f"{path}/centres")
    return VectorIndex(path, centres, rows, widest)


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return VectorIndex(path, np.array([r.centre for r in rows]), np.array([r.n for r in rows], np.int64), np.array([r.widest for r in rows]))


def scored(index: VectorIndex, spark: SparkSession, query: list[float], cells: list[int]) -> DataFrame:
    """The vectors of the cells with their score; other partitions aren't read, norms aren't computed again."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with("vector", q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    rows = index.table(spark).where(F.col("cell").isin([int(c) for c in cells]))
    return rows.withColumn("score", dot / (F.col("norm") * F.lit(norm))).drop("vector", "norm", "angle")


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of largest score, ties by vec_id, with their rank from 1."""
    best = rows.orderBy(F.desc("score"), "vec_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))


def search(index: VectorIndex, spark: SparkSession, query: list[float], k: int, probes: int, scope: Column | None = None) -> DataFrame:
    """The k nearest among the vectors of the probes nearest cells that are in scope."""
    rows = scored(index, spark, query, list(index.nearest_cells(query)[:probes]))
    return top(rows.where(scope) if scope is not None else rows, k)


def search_exact(index: VectorIndex, spark: SparkSession, query: list[float], k: int, probes: int = 1, scope: Column | None = None) -> DataFrame:
    """The k nearest of all vectors in scope: the nearest cells give a k-th score, and every cell whose bound reaches it is read as well."""
    cells = index.nearest_cells(query)
    near = search(index, spark, query, k, probes, scope).select("score").collect()  # k rows
    least = near[k - 1].score if len(near) >= k else -2.0
    bound = index.best_cosine(query)
    wanted = [int(c) for i, c in enumerate(cells) if i < probes or bound[c] >= least]
    rows = scored(index, spark, query, wanted)
    return top(rows.where(scope) if scope is not None else rows, k)


def _shards(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each cell and their number: a large cell is cut into shards of up to size rows, small ones after each other share one."""
    first, parts, shard, room = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), -1, 0
    for cell, n in enumerate(rows):
        if n > room:
            shard, parts[cell], room = shard + 1, -(-n // size), size
        first[cell], room = max(shard, 0), room - n
        if parts[cell] > 1:
            shard, room = shard + int(parts[cell]) - 1, 0
    return first, parts


def _first(k: int, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the k best of each query, by query; a score that is no number is above all, as Spark and SQL have it, ties go by id."""
    order = np.lexsort((ids, -np.where(np.isnan(score), np.inf, score), query))
    own = query[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _dots(x: np.ndarray, q: np.ndarray, at: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Products of the columns at of x and by of q, summed one position after the other, so that equal vectors have equal products."""
    total = np.zeros(len(at))
    for a, b in zip(x, q, strict=True):
        total += a[at] * b[by]
    return total


def _best_of(vectors, asked, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in asked, vec_id, score) of the k nearest of vectors (vec_id, vector, norm, cell) for each row of asked (query, cells).

    Equal vectors of a cell are one and give their k least ids. A matrix product finds what may be among the k, within the error of
    rounding; these are computed again, so that neither copies nor the order of rows change a score.
    """
    import pyarrow as pa

    x, q = (_rows(t.column(c)).reshape(-1, dim) for t, c in ((vectors, "vector"), (asked, "query")))
    ids, cells = vectors.column("vec_id").to_numpy(), vectors.column("cell").to_numpy()
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    _, at, one = np.unique(np.column_stack([cells, x]).view(np.dtype((np.void, 8 * (dim + 1)))).ravel(), return_index=True, return_inverse=True)
    kept = _first(k, one, np.zeros(len(ids)), ids)
    ids, start, count = ids[kept], np.searchsorted(one[kept], np.arange(len(at))), np.bincount(one[kept], minlength=len(at))
    x, norms, cells = x[at], vectors.column("norm").to_numpy()[at], cells[at]
    own, cell = np.unique(cells, return_inverse=True)
    columns, odd = np.ascontiguousarray(x.T), ~np.isfinite(norms)
    lists = asked.column("cells")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    wanted, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()

    def near(part, sizes, asks):
        """Pairs that may be among the k of a query, by cells with the same queries."""
        kinds, kind = (asks[:, :1], np.zeros(len(own), np.int64)) if asks.all() else np.unique(asks, axis=1, return_inverse=True)
        kind = kind.ravel()
        for g in range(kinds.shape[1]):
            who, rows = np.flatnonzero(kinds[:, g]), np.flatnonzero(kind[cell] == g)
            if not len(who):
                continue
            rough = part[who] @ (x if len(rows) == len(x) else x[rows]).T
            rough /= norms[rows]
            rough /= sizes[who, None]
            if odd[rows].any():
                rough[:, odd[rows]] = -np.inf
            least = np.partition(rough, -k, axis=1)[:, -k, None] if len(rows) > k else -np.inf
            i, j = np.nonzero(~(rough < least - SLACK) | odd[rows])
            yield who[i], rows[j]

    out, step = [], max(1, SCORES // len(x))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        turned = np.ascontiguousarray(part.T)
        sizes = np.sqrt(_dots(turned, turned, *[np.arange(len(part))] * 2))
        sizes[sizes == 0] = 1.0
        cut = ends[a : a + step + 1]
        mine = wanted[cut[0] : cut[-1]]
        place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
        here = own[place] == mine
        asks = np.zeros((len(part), len(own)), bool)
        asks[np.repeat(np.arange(len(part)), np.diff(cut))[here], place[here]] = True
        pairs = list(near(part, sizes, asks))
        if not pairs:
            continue
        i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
        score = _dots(columns, turned, j, i) / (norms[j] * sizes[i])
        best = _first(k, i, score, ids[start[j]])
        i, j, score = i[best], j[best], score[best]
        each = np.repeat(np.arange(len(j)), count[j])
        found = ids[start[j][each] + np.arange(len(each)) - (np.cumsum(count[j]) - count[j])[each]]
        best = _first(k, i[each], score[each], found)
        out.append((a + i[each][best], found[best], score[each][best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search_many(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, vec_id, score, rank) for all of queries (query_id, vector), each against its probes nearest cells.

    Cells are dealt to shards of up to TASK_NUMBERS numbers and queries to blocks of up to ASKED_NUMBERS. A query goes once to each
    shard of its cells, with their names: a task holds one shard and one block, whatever the number of cells, and hands on k rows for each query.
    """
    spark, dim = queries.sparkSession, index.centres.shape[1]
    held, centres = index.rows > 0, index.centres
    each = -(-int(index.rows.sum()) // spark.sparkContext.defaultParallelism)  # small tables occupy all cores, too
    first, parts = _shards(index.rows, max(1, min(TASK_NUMBERS // max(1, dim), max(LEAST_ROWS, each))))
    # queries that are dealt at a time
    step = max(1, ASKED_NUMBERS // max(1, dim * int((first + parts).max(initial=1)), len(centres)))

    def probed(batches):
        import pyarrow as pa

        for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            dots = np.where(held, _units(batch.column(1)) @ centres.T, -np.inf)
            take = np.argsort(-dots, axis=1, kind="stable")[:, : min(probes, int(held.sum()))]
            cell = take.ravel()
            each = np.repeat(np.arange(len(cell)), parts[cell])
            shard = first[cell][each] + np.arange(len(each)) - (np.cumsum(parts[cell]) - parts[cell])[each]
            row = each // max(1, take.shape[1])
            order = np.lexsort((shard, row))
            row, shard, cell = row[order], shard[order], cell[each][order]
            new = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(shard, prepend=-1))
            rows, cells = pa.array(row[new]), pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(shard[new].astype(np.int32)), cells], ["query_id", "query", "shard", "cells"])

    def scores(key, vectors, asked):
        import pyarrow as pa

        at, vec, score = _best_of(vectors, asked, dim, k)
        return pa.table([asked.column("query_id").take(pa.array(at)), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    kind = queries.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-queries.count() // max(1, ASKED_NUMBERS // max(1, dim))))
    asked = queries.where(F.size("vector") == dim).select("query_id", "vector").mapInArrow(probed, f"query_id {kind}, query array<double>, shard int, cells array<int>")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    dealt = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in np.flatnonzero(held).tolist()], "cell int, first int, parts int")
    vectors = index.table(spark).select("vec_id", "vector", "norm", "cell").join(F.broadcast(dealt), "cell")
    vectors = vectors.withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")).drop("first", "parts")
    vectors = vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = vectors.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(scores, f"query_id {kind}, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
