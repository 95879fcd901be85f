"""Sharding by best-fit-decreasing bin packing (operator 8).

Documents of equal text are one indivisible group. Groups enter by falling size the bin of the
tightest remaining capacity that holds them; the bins stand in a balanced tree by remaining capacity.

Groups of equal size are interchangeable, and after one of them enters a bin, the next enters the
same bin while it fits. So the packing runs over the distinct sizes with their numbers of groups,
which gives the same bins as group by group. Distinct sizes are few: k of them need k * k / 2 bytes
of text, so 100 TB has under 15 million at the very most. Bins of equal rest capacity that follow
each other are one node of the tree, so a size adds a few nodes, however many bins it fills. The driver holds
the distinct sizes and these nodes; every group finds its run of the plan by its size and its rank
among the groups of that size, in a join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 16
#: Cells of a shard, or of the groups of one size, in which rows are numbered on their own.
CELLS = 1024
#: Ranks that share a key in the join with the plan.
BLOCK = 1024
#: The plan is broadcast up to so many rows, 10 MB; beyond it the join shuffles.
BROADCAST_RUNS = 250_000


class CapacityTree:
    """Runs of bins (capacity, first bin, number) by remaining capacity in a treap: O(log n) insert, remove and search for the least that is enough."""

    __slots__ = ("root", "seed")

    def __init__(self):
        self.root, self.seed = None, 88172645463325252

    def _priority(self) -> int:
        x = self.seed
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self.seed = x
        return x

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0][:2] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, capacity: int, first: int, bins: int = 1) -> None:
        low, high = self._split(self.root, (capacity, first))
        self.root = self._merge(self._merge(low, [(capacity, first, bins), self._priority(), None, None]), high)

    def take_tightest(self, size: int):
        """Removes and returns the run of least capacity >= size, or None."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]


class Run(NamedTuple):
    """count groups of one size, from rank start on, in bins of `each` groups from `bin` on."""

    size: int
    start: int
    count: int
    each: int
    bin: int


def best_fit_runs(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Run] | None:
    """Best-fit-decreasing of groups given as (size, number of groups); None if more than `most` bins are needed or a group exceeds the capacity."""
    tree, used, runs = CapacityTree(), 0, []
    for size, count in sorted(classes, reverse=True):
        if size > capacity:
            return None
        start = 0
        while start < count:
            found = tree.take_tightest(size)
            if found is not None:
                # equal groups fill the run's bins one after the other; the last may take fewer
                left, first, bins = found
                each = min(count - start, left // size)
                full = min(bins, (count - start) // each)
                runs.append(Run(size, start, full * each, each, first))
                tree.add(left - each * size, first, full)
                if full < bins:
                    tree.add(left, first + full, bins - full)
                start += full * each
                continue
            each = min(count - start, capacity // size)
            bins = (count - start) // each
            if most is not None and used + bins > most:
                return None
            runs.append(Run(size, start, bins * each, each, used))
            tree.add(capacity - each * size, used, bins)
            used, start = used + bins, start + bins * each
    return runs


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> dict[int, int] | None:
    """Bin of each item (id, size), equal sizes by id; None as in best_fit_runs."""
    held: dict[int, list[int]] = {}
    for name, size in sorted(sizes):
        held.setdefault(size, []).append(name)
    runs = best_fit_runs([(s, len(v)) for s, v in held.items()], capacity, most)
    return None if runs is None else {held[r.size][r.start + i]: r.bin + i // r.each for r in runs for i in range(r.count)}


def fewest_equal(classes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Near-equal shards. A group of an equal share or more gets a shard of its own; the others are packed at the least capacity (to 1 / 100,000) at which best fit needs no more than the shards left."""
    left, total, alone, rest = shards, sum(s * n for s, n in classes), [], []
    for size, count in sorted(classes, reverse=True):
        start = 0
        while start < count and left > 1 and size * left >= total:
            alone.append(Run(size, start, 1, 1, len(alone)))
            start, left, total = start + 1, left - 1, total - size
        rest.append((size, count, start))
    classes = [(size, count - start) for size, count, start in rest if count > start]
    low = max(-(-total // left), max((s for s, _ in classes), default=1))
    found = best_fit_runs(classes, low, left)
    high = low
    while found is None:
        low, high = high, high + max(1, high // 8)
        found = best_fit_runs(classes, high, left)
    while high - low > max(1, high // 100_000):
        mid = (low + high) // 2
        if (better := best_fit_runs(classes, mid, left)) is not None:
            high, found = mid, better
        else:
            low = mid
    taken = {size: start for size, _, start in rest}
    return alone + [r._replace(start=r.start + taken[r.size], bin=r.bin + len(alone)) for r in found]


def _ranked(groups: DataFrame) -> DataFrame:
    """groups (h1, h2, bytes) with their rank from 0 among those of equal bytes; a size with very many groups is numbered cell by cell."""
    cell = F.pmod("h1", F.lit(CELLS)).cast("int")
    groups = groups.withColumn("cell", cell)
    cells = groups.groupBy("bytes", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("bytes", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = Window.partitionBy("bytes", "cell").orderBy("h1", "h2")
    return groups.withColumn("r", F.row_number().over(own) - 1).join(cells, ["bytes", "cell"]).select("h1", "h2", "bytes", (F.col("begin") + F.col("r")).alias("rank"))


def _placed(groups: DataFrame, runs: list[Run]) -> DataFrame:
    """(h1, h2, shard) of every group by the plan."""
    spark = groups.sparkSession
    plan = spark.createDataFrame(runs, "size long, start long, count long, each long, bin long")
    blocks = sum((r.start + r.count - 1) // BLOCK - r.start // BLOCK + 1 for r in runs)
    whole = lambda x: F.floor(x / F.lit(BLOCK)).cast("long")
    plan = plan.withColumn("block", F.explode(F.sequence(whole(F.col("start")), whole(F.col("start") + F.col("count") - 1))))
    ranked = _ranked(groups).withColumn("block", whole(F.col("rank")))
    inside = (F.col("bytes") == F.col("size")) & (ranked["block"] == plan["block"]) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("count"))
    found = ranked.join(F.broadcast(plan) if blocks <= BROADCAST_RUNS else plan, inside)
    return found.select("h1", "h2", (F.col("bin") + F.floor((F.col("rank") - F.col("start")) / F.col("each"))).cast("int").alias("shard"))


def pack(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs (doc_id, text).

    With a capacity, the shards are those best-fit-decreasing needs, and only a group larger than
    the capacity raises ValueError; without, there are `shards` of near-equal bytes. size is the
    text's UTF-8 bytes plus 1 (null: 1). Equal texts share a shard; a null text equals no other but
    those under its doc_id. Slots count from 0 without gaps in every shard, by cell, doc_id and text.
    Repeated rows get slots of their own, so do rows without an id. Empty tables give an empty
    result; extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    missing = F.col("text").isNull()
    rows = C.cut(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(missing, F.xxhash64(F.lit(0), "doc_id")).otherwise(F.xxhash64("text")).alias("h1"),
        F.when(missing, F.lit(0)).otherwise(F.xxhash64(F.lit("second"), "text")).alias("h2"),
    ))
    groups = C.cut(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")))
    classes = [tuple(r) for r in groups.groupBy("bytes").count().collect()]  # distinct sizes
    runs = best_fit_runs(classes, capacity) if capacity else fewest_equal(classes, shards)
    if runs is None:
        raise ValueError("a group of equal texts exceeds the capacity")
    rows = rows.join(_placed(groups, runs), ["h1", "h2"]).withColumn("cell", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(CELLS)).cast("int"))
    rows = C.cut(rows.select("doc_id", "size", "text_crc32", "shard", "cell", "h1"))
    cells = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "cell").orderBy("doc_id", "h1", "text_crc32")
    numbered = rows.withColumn("r", F.row_number().over(own) - 1).join(cells, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("r")).alias("slot"))


def op8_bin_packing(spark, sf_dir):
    found = pack(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
