"""Array and map helpers: positional zips, distinct values, merged maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zipped(first: Column, second: Column) -> Column:
    """Pairs (a, b) by position; null where the lengths differ."""
    return F.when(F.size(first) == F.size(second), F.arrays_zip(first.alias("a"), second.alias("b")))


def distinct_in_order(rows: DataFrame, key: str, value: str, place: Column) -> DataFrame:
    """(key, values): the distinct values of each key in the order of their first place, ties by value. Repeated values are combined before the shuffle."""
    first = rows.groupBy(key, value).agg(F.min(place).alias("first_place"))
    return first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first_place", F.col(value).alias("v"))))["v"].alias("values"))


def sorted_distinct(values: Column) -> Column:
    """Aggregate: distinct trimmed values in lower case, sorted."""
    return F.array_sort(F.collect_set(F.lower(F.trim(values))))


def merged_maps(*maps: Column) -> Column:
    """One map; of equal keys the last map's value stays, whatever the session's policy for repeated keys."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without_keys_of(m, out), m)
    return out


def _without_keys_of(other: Column, values: Column) -> Column:
    return F.map_filter(values, lambda k, v: ~F.map_contains_key(other, k))


def without_nulls(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda k, v: v.isNotNull())
