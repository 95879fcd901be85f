"""Visual style: a preset blended into the user's adjustments, and the resulting filter values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, rounded

#: Neutral, least and most of each adjustment. Fixed values.
ADJUSTMENTS = {
    "exposure": (0, -100, 100), "brightness": (100, 0, 200), "contrast": (100, 0, 200), "temperature": (0, -100, 100), "tint": (0, -100, 100),
    "saturation": (100, 0, 200), "vibrance": (100, 0, 200), "lift": (0, -100, 100), "gamma": (0, -100, 100), "gain": (0, -100, 100),
}
#: Adjustments of each preset that differ from neutral. Fixed values.
PRESETS = {
    "Original": {},
    "Cinematic": {"exposure": -4, "brightness": 98, "contrast": 118, "temperature": -6, "tint": 2, "saturation": 106, "vibrance": 110, "lift": -4, "gamma": 8, "gain": 4},
    "Film": {"exposure": 2, "contrast": 108, "temperature": 8, "tint": 4, "saturation": 88, "vibrance": 95, "lift": 6, "gamma": -4, "gain": -3},
    "Vintage": {"brightness": 104, "contrast": 92, "temperature": 18, "tint": 8, "saturation": 78, "vibrance": 86, "lift": 12, "gamma": -8, "gain": -6},
    "Warm": {"brightness": 103, "temperature": 25, "tint": 3, "saturation": 108, "vibrance": 106},
    "Cold": {"brightness": 101, "temperature": -25, "tint": -3, "saturation": 104, "vibrance": 108},
    "Dreamy": {"exposure": 8, "brightness": 108, "contrast": 88, "temperature": 6, "tint": 8, "saturation": 96, "vibrance": 112, "lift": 10, "gamma": -8, "gain": 4},
    "Noir": {"brightness": 96, "contrast": 132, "saturation": 0, "vibrance": 0, "gamma": 12, "gain": 4},
    "Vivid": {"brightness": 102, "contrast": 116, "saturation": 125, "vibrance": 135, "gain": 8},
}


def preset_of(built_in: Column, lut: Column) -> Column:
    """The built-in choice, or the look-up table's if there is none; unknown names are Original, Cool is Cold."""
    chosen = F.when(F.coalesce(built_in, F.lit("Original")).isin("", "None", "Original"), F.coalesce(lut, F.lit("Original"))).otherwise(built_in)
    chosen = F.when(chosen == "Cool", "Cold").otherwise(chosen)
    return F.when(chosen.isin(list(PRESETS)), chosen).otherwise("Original")


def adjusted(preset: Column, users: dict[str, Column], intensity: Column, blend: Column) -> Column:
    """Struct of the resolved adjustments: user + (preset - neutral) * share, clamped, to 6 places."""
    share = clamp(intensity, 0, 100) / 100 * (clamp(blend, 0, 100) / 100)
    fields = []
    for name, (neutral, low, high) in ADJUSTMENTS.items():
        shift = F.lit(0.0)
        for p, values in PRESETS.items():
            if name in values:
                shift = F.when(preset == p, F.lit(float(values[name] - neutral))).otherwise(shift)
        user = F.coalesce(users[name], F.lit(float(neutral))) if name in users else F.lit(float(neutral))
        fields.append(rounded(clamp(user + shift * share, low, high), 6).alias(name))
    return F.struct(*fields)


def filter_values(a: Column) -> Column:
    """Struct of the five filter values of resolved adjustments."""
    return F.struct(
        rounded(clamp(a["brightness"] / 100 + a["exposure"] / 240 + a["lift"] / 320, 0.08, 3), 6).alias("brightness"),
        rounded(clamp(a["contrast"] / 100 + a["gamma"] / 260 + a["gain"] / 420, 0.08, 3), 6).alias("contrast"),
        rounded(clamp(a["saturation"] / 100 + (a["vibrance"] - 100) / 260 + a["gain"] / 340, 0, 3.5), 6).alias("saturation"),
        rounded(clamp(a["temperature"] * -0.18 + a["tint"] * 0.22, -45, 45), 6).alias("hue_rotate"),
        rounded(clamp(F.greatest(F.lit(0.0), a["temperature"]) / 420, 0, 0.28), 6).alias("sepia"),
    )
