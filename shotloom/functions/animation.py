"""Keyframe tracks evaluated with array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST = 2.0**-52


def between(left: Column, right: Column, time: Column) -> Column:
    """Value between two keyframes: the right one's easing bends the progress with its second and fourth number."""
    p = (time - left["time"]) / F.greatest(F.lit(SMALLEST), right["time"] - left["time"])
    e = right["easing"]
    eased = 3 * (1 - p) * (1 - p) * p * F.get(e, F.lit(1)) + 3 * (1 - p) * p * p * F.get(e, F.lit(3)) + p * p * p
    progress = F.when(e.isNotNull(), eased).otherwise(p)
    return left["value"] + (right["value"] - left["value"]) * progress


def evaluate(track: Column, time: Column, fallback: Column) -> Column:
    """Value of a track (array of time, value, easing) at a time.

    Held before the first and after the last keyframe. An empty or null track gives the fallback.
    """
    own = F.array_sort(track, lambda a, b: F.when(a["time"] < b["time"], -1).when(a["time"] > b["time"], 1).otherwise(0))
    first, last = F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(-1))
    left = F.try_element_at(F.filter(own, lambda k: k["time"] < time), F.lit(-1))
    right = F.try_element_at(F.filter(own, lambda k: k["time"] >= time), F.lit(1))
    return F.when(F.coalesce(F.size(track), F.lit(0)) <= 0, fallback).when(time <= first["time"], first["value"]).when(time >= last["time"], last["value"]).otherwise(between(left, right, time))


def faded_opacity(base: Column, time: Column, duration: Column, fade_in: Column, fade_out: Column) -> Column:
    into, out = F.least(fade_in, duration), F.least(fade_out, duration)
    gain_in = F.when(into > 0, F.least(F.lit(1.0), time / into)).otherwise(1.0)
    gain_out = F.when((out > 0) & (time > duration - out), F.greatest(F.lit(0.0), (duration - time) / F.greatest(out, F.lit(0.001)))).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * gain_in * gain_out))


def evaluated_state(tracks: dict[str, Column], time: Column, fallbacks: dict[str, Column]) -> Column:
    """A struct of all animated values of an item (transform and crop) at a time."""
    return F.struct(*(evaluate(tracks[k], time, fallbacks[k]).alias(k) if k in tracks else fallbacks[k].alias(k) for k in fallbacks))
