"""Operators along an order: running sums, carried values, as-of joins, the sweep line and shot cuts.

A window over a key is one task however many rows the key has. Here rows are cut by ranges of (key,
order) into parts, which split a hot key like any other rows, and are written with their part. Windows run
inside a part of a key; what goes over its edge, a sum or a last value, is computed for the parts, of which
a key has as many as there are partitions at most, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.animation import between
from ..workspace import written

#: The column that numbers the parts. Inputs must not have it.
PART = "ordered_part"
#: Rows of a part, about; a part's windows are one task.
PART_ROWS = 200_000


def in_parts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows, written, with the number of their part; parts follow each other in the order of (keys, order). Rows that are equal in these are in one part.

    Rows are written before, too: they are counted for the number of parts, and sampled for their bounds, without computing them again.
    """
    held = written(rows, "ordered_rows")
    n = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // PART_ROWS))
    parts = written(held.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()), "ordered")
    parts.ordered_parts = n  # for _dealt
    return parts


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows straight from in_parts, dealt to as many tasks as there are parts, whatever adaptive execution would join; others lie so already."""
    n = getattr(rows, "ordered_parts", None)
    return rows.repartition(n, *keys, PART) if n else rows


def _inside(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, PART).orderBy(*order)


def _cut(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the first and the last key of each part: the only ones that other parts can have too, two keys a part at most."""
    key = F.struct(*(F.col(k).alias(f"ordered_key_{i}") for i, k in enumerate(keys)))
    ends = rows.groupBy(PART).agg(F.min(key).alias("a"), F.max(key).alias("b")).select(F.col(PART).alias("ordered_key_part"), F.inline(F.array_distinct(F.array("a", "b"))))
    same = [F.col(k).eqNullSafe(F.col(f"ordered_key_{i}")) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(ends), [F.col(PART) == F.col("ordered_key_part"), *same], "left_semi")


def _with_edges(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with what reaches their part; keys may be null. edges: of the rows of _cut."""
    named = {k: f"ordered_key_{i}" for i, k in enumerate([*keys, PART])}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    return rows.join(F.broadcast(edges.withColumnsRenamed(named)), same, "left").drop(*named.values())


def running_sums(rows: DataFrame, keys: list[str], order: list[str], **sums: str) -> DataFrame:
    """rows (of in_parts) with each named sum of a column over the rows of the key up to this one. The order must tell all rows of a key apart."""
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = _cut(rows, keys).groupBy(*keys, PART).agg(*(F.sum(c).alias(f"ordered_{n}") for n, c in sums.items()))
    parts = parts.select(*keys, PART, *(F.sum(f"ordered_{n}").over(before).alias(f"ordered_{n}") for n in sums))
    own = _with_edges(_dealt(rows, keys).withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}), parts, keys)
    return own.withColumns({n: F.col(n) + F.coalesce(f"ordered_{n}", F.lit(0)) for n in sums}).drop(*(f"ordered_{n}" for n in sums))


def largest_before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows (of in_parts) with the largest value of the key's rows before this one; null without any."""
    own = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = _cut(rows, keys).groupBy(*keys, PART).agg(F.max(value).alias("ordered_top")).select(*keys, PART, F.max("ordered_top").over(over).alias("ordered_top"))
    found = _with_edges(_dealt(rows, keys).withColumn(name, F.max(value).over(own)), parts, keys)
    return found.withColumn(name, F.greatest(name, "ordered_top")).drop("ordered_top")


def _window(keys: list[str], order: list[str], forward: bool, this: bool):
    turned = order if forward else [F.desc(c) for c in order]
    return Window.partitionBy(*keys, PART).orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if this else -1)


def _edge(rows: DataFrame, keys: list[str], order: list[str], value: str, forward: bool) -> DataFrame:
    """(keys, PART, ordered_end): the last value that isn't null of the parts of a key before this one, or, not forward, the first of those after it."""
    over = Window.partitionBy(*keys).orderBy(PART if forward else F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    take = F.max_by if forward else F.min_by
    ends = _cut(rows, keys).groupBy(*keys, PART).agg(take(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("ordered_end"))
    return ends.select(*keys, PART, F.last("ordered_end", ignorenulls=True).over(over).alias("ordered_end"))


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, forward: bool = True, this: bool = True) -> DataFrame:
    """rows (of in_parts) with the last value that isn't null of the key up to this row, or without this row; or, not forward, the first from this row on. The order must tell all rows of a key apart."""
    own, ends = _window(keys, order, forward, this), _edge(rows, keys, order, value, forward)
    found = _with_edges(_dealt(rows, keys).withColumn(name, F.last(value, ignorenulls=True).over(own)), ends, keys)
    return found.withColumn(name, F.coalesce(name, "ordered_end")).drop("ordered_end")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, backward: bool = True, name: str = "matched") -> DataFrame:
    """left with the struct name of the row of right that is the last at or before its time under equal keys (not backward: the first at or after it), null without one.

    Of right rows with equal keys and time the greatest (not backward: the least) by their other columns counts. Rows with a
    null key or time match nothing and stay. Repeated left rows stay.
    """
    others = [c for c in right.columns if c not in keys]
    fits = F.col(time).isNotNull()
    for k in keys:
        fits = fits & F.col(k).isNotNull()
    pick = F.max if backward else F.min
    facts = right.where(fits).groupBy(*keys, F.col(time).alias("ordered_time")).agg(pick(F.struct(*others)).alias(name))
    asked = left.where(fits).select(F.struct(*(F.col(c) for c in left.columns)).alias("ordered_row"), *keys, F.col(time).alias("ordered_time"))
    asked = asked.withColumns({"ordered_side": F.lit(1 if backward else 0), "ordered_id": F.monotonically_increasing_id(), name: F.lit(None).cast(facts.schema[name].dataType)})
    facts = facts.withColumns({"ordered_side": F.lit(0 if backward else 1), "ordered_id": F.lit(-1).cast("long"), "ordered_row": F.lit(None).cast(asked.schema["ordered_row"].dataType)})
    rows = in_parts(asked.unionByName(facts), keys, ["ordered_time", "ordered_side", "ordered_id"])
    found = carried(rows, keys, ["ordered_time", "ordered_side", "ordered_id"], name, "ordered_found", forward=backward)
    hit = found.where("ordered_row IS NOT NULL").select("ordered_row.*", F.col("ordered_found").alias(name))
    return hit.unionByName(left.where(~F.coalesce(fits, F.lit(False))).withColumn(name, F.lit(None).cast(facts.schema[name].dataType)))


def keyframe_values(queries: DataFrame, keyframes: DataFrame, track: str = "track_id", time: str = "time") -> DataFrame:
    """queries with value: what the keyframes (track, time, value, easing) of their track give at their time, null for a track without keyframes.

    Held before the first and after the last keyframe, eased by the right one between, as one row's track of keyframes is.
    """
    fits = F.col(track).isNotNull() & F.col(time).isNotNull()
    one = F.struct(time, "value", "easing")
    facts = keyframes.where(fits).groupBy(track, F.col(time).alias("ordered_time")).agg(F.struct(F.max(one).alias("last"), F.min(one).alias("first")).alias("ordered_fact"))
    asked = queries.where(fits).select(F.struct(*(F.col(c) for c in queries.columns)).alias("ordered_row"), track, F.col(time).alias("ordered_time"), F.monotonically_increasing_id().alias("ordered_id"))
    order = ["ordered_time", "ordered_id"]
    parts = in_parts(asked.unionByName(facts.withColumn("ordered_id", F.lit(-1).cast("long")), allowMissingColumns=True), [track], order)
    after = _edge(parts, [track], order, "ordered_fact", False).withColumnRenamed("ordered_end", "after_end")
    own = carried(parts, [track], order, "ordered_fact", "ordered_before")
    own = _with_edges(own.withColumn("ordered_after", F.last("ordered_fact", ignorenulls=True).over(_window([track], order, False, True))), after, [track])
    own = own.where("ordered_row IS NOT NULL").withColumn("ordered_after", F.coalesce("ordered_after", "after_end"))
    before, now = F.col("ordered_before"), F.col("ordered_before")["last"][time] == F.col("ordered_time")
    found = own.select("ordered_row.*", before["last"].alias("keyframe_before"), F.when(now, before["first"]).otherwise(F.col("ordered_after")["first"]).alias("keyframe_after"))
    both = found.unionByName(queries.where(~fits), allowMissingColumns=True)
    low, high = F.col("keyframe_before"), F.col("keyframe_after")
    inside = between(low, high, F.col(time))
    value = F.when(low.isNull(), high["value"]).when(high.isNull(), low["value"]).when(high[time] == F.col(time), high["value"]).otherwise(inside)
    return both.withColumn("value", value).drop("keyframe_before", "keyframe_after")


def active_segments(items: DataFrame, fps: int, key: str = "document_id", weight: str = "track_index") -> DataFrame:
    """(key, from_frame, to_frame, layers, weight_sum): the maximal runs of frames between two changes in which items are active, with their number and their sum of weights.

    An item adds itself at its first frame and takes itself away after its last one. There are up to two rows an item,
    whatever its length and the frame rate; frames without items are in no run. Items of null bounds are left out.
    """
    first = F.ceil(F.col("timeline_start") * fps)
    after = F.ceil((F.col("timeline_start") + F.col("duration")) * fps)
    own = items.where(after > first).select(key, F.col(weight).cast("long").alias("weight"), first.cast("long").alias("a"), after.cast("long").alias("b"))
    change = lambda frame, sign: F.struct(F.col(frame).alias("from_frame"), F.lit(sign).cast("long").alias("n"), (F.col("weight") * sign).alias("w"))
    events = own.select(key, F.inline(F.array(change("a", 1), change("b", -1)))).groupBy(key, "from_frame").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    rows = in_parts(events.where("n <> 0 OR w <> 0"), [key], ["from_frame"])
    sums = running_sums(rows, [key], ["from_frame"], layers="n", weight_sum="w")
    ends = carried(sums, [key], ["from_frame"], "from_frame", "next_frame", forward=False, this=False)
    return ends.where("layers > 0").select(key, "from_frame", (F.col("next_frame") - 1).alias("to_frame"), "layers", "weight_sum")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1.0 - dot(a, b) / norms).otherwise(0.0)


def shot_cuts(frames: DataFrame, threshold: float, least: int, key: str = "media_id", order: str = "frame") -> DataFrame:
    """(key, order, distance): the frames at which a shot begins, other than the first of a media.

    A frame whose vector differs from the one before by threshold or more may begin a shot, if the last one began least
    frames before or earlier (the media's first frame begins one). Candidates that are least frames or more
    after the candidate before them always do, so only runs of closer ones are folded in order.
    """
    rows = in_parts(frames.where(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col("vector").isNotNull()).select(key, order, "vector"), [key], [order])
    seen = carried(rows, [key], [order], "vector", "vector_before", this=False)
    far = seen.withColumn("distance", cosine_distance(F.col("vector_before"), F.col("vector")))
    starts = far.where(F.col("vector_before").isNull() | (F.col("distance") >= threshold)).select(key, order, F.when(F.col("vector_before").isNotNull(), F.col("distance")).alias("distance"))
    marks = in_parts(starts, [key], [order])
    near = carried(marks, [key], [order], order, "order_before", this=False)
    near = near.withColumn("new", (F.col("order_before").isNull() | (F.col(order) - F.col("order_before") >= least)).cast("long"))
    runs = running_sums(near, [key], [order], run="new")
    one = F.struct(F.col(order).alias("at"), "distance")
    chain = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(one)).alias("all"))
    last = lambda kept: F.try_element_at(kept, F.lit(-1))["at"]
    folded = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when((F.size(kept) == 0) | (x["at"] - last(kept) >= least), F.concat(kept, F.array(x))).otherwise(kept))
    return chain.select(key, F.inline(folded)).where("distance IS NOT NULL").select(key, F.col("at").alias(order), "distance")
