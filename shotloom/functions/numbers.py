"""Scalar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(value.isNotNull(), F.least(high, F.greatest(low, value)))


def rounded(value: Column, places: int) -> Column:
    """The double nearest to the binary value rounded to up to 6 places, half to even, as correct rounding gives it.

    value * 10^places is split into a product and its error (Dekker), so that ties are told from values
    just above or below, which decimal text can't do: 2.6755 is less than its text and becomes 2.675.
    """
    scale = float(10**places)

    def exact(x):
        high = x * 134217729.0 - (x * 134217729.0 - x)
        error = (high * scale - x * scale) + (x - high) * scale
        floor = F.floor(x * scale).cast("double")
        above = (x * scale - (floor + 0.5)) + error
        up = (above > 0) | ((above == 0) & (F.pmod(floor, F.lit(2.0)) == 1))
        # a product that rounds up to a whole number may have its floor one too high
        low = (x * scale == floor) & (error < 0)
        near = F.when(low, floor).otherwise(F.when(up, floor + 1).otherwise(floor))
        return F.when(F.abs(x) < 1e9, near / scale).otherwise(F.round(x, places))

    # a lambda, so that the value's expression stands in the plan once however calls are nested
    return F.get(F.transform(F.array(value.cast("double")), exact), F.lit(0))


def round3(value: Column) -> Column:
    return rounded(value, 3)


def strict_number(text: Column, default: float | None) -> Column:
    """A finite number from text; booleans, NaN, infinities and other text give the default."""
    number = text.try_cast("double")
    good = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")) & ~F.lower(text).isin("true", "false")
    return F.when(good, number).otherwise(F.lit(default))


def tempo_factors(speed: Column) -> Column:
    """Factors in [0.5, 2] whose product is the speed: doublings or halvings, then the rest."""
    n_up = F.greatest(F.lit(0), F.ceil(F.log2(speed)) - 1).cast("int")
    n_down = F.greatest(F.lit(0), F.ceil(-F.log2(speed)) - 1).cast("int")
    rest = speed / F.pow(F.lit(2.0), n_up) * F.pow(F.lit(2.0), n_down)
    return F.concat(F.array_repeat(F.lit(2.0), n_up), F.array_repeat(F.lit(0.5), n_down), F.array(rest))


def source_range(item_type, source_in, source_out, speed, item_start, start, duration) -> Column:
    """Source in and out of a timeline range; ok is false if it leaves the source. Other types have none and are ok."""
    rate = F.coalesce(F.nullif(speed, F.lit(0.0)), F.lit(1.0))
    media = item_type.isin("video", "audio")

    def of(first, last):
        inside = (first >= source_in) & (last <= source_out) & (last > first)
        return F.struct(F.when(media & inside, first).alias("source_in"), F.when(media & inside, last).alias("source_out"), (~media | F.coalesce(inside, F.lit(False))).alias("ok"))

    # lambdas, so that each rounded value is computed once
    both = F.transform(F.array(round3(source_in + (start - item_start) * rate)), lambda first: F.struct(first.alias("first"), round3(first + duration * rate).alias("last")))
    return F.get(F.transform(both, lambda b: of(b["first"], b["last"])), F.lit(0))


def frame_count(duration: Column, fps: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0.1), duration) * fps)).cast("long")


def letterbox(out_w, out_h, w, h) -> Column:
    scale = F.least(out_w / w, out_h / h)
    return F.struct(scale.alias("scale"), ((out_w - w * scale) / 2).alias("offset_x"), ((out_h - h * scale) / 2).alias("offset_y"))


def keeps_aspect(w, h, logical_w, logical_h) -> Column:
    return (logical_w > 0) & (logical_h > 0) & (F.abs(w * logical_h - h * logical_w) <= F.greatest(logical_w, logical_h))


def layer_geometry(width, height, left, top, right, bottom, scale) -> Column:
    """Cropped size in pixels, half-even, at least 1, times the scale."""
    whole = lambda x: F.bround(x, 0).cast("long")
    w, h = whole((1 - left - right) * width), whole((1 - top - bottom) * height)
    return F.struct(whole(left * width).alias("x"), whole(top * height).alias("y"), F.greatest(F.lit(1), whole(w * scale)).alias("w"), F.greatest(F.lit(1), whole(h * scale)).alias("h"))


def jittered_ttl(ttl: Column, percent: float, seed: int = 1) -> Column:
    return F.greatest(F.lit(1), F.round(ttl * (1 + (F.rand(seed) * 2 - 1) * percent / 100))).cast("long")
