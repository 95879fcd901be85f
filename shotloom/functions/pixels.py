"""The visual filter on raw RGBA pixels, as an Arrow UDF."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Luminance weights, sepia matrix, and the hue rotation's cosine and sine parts (CSS filter primitives). Fixed values.
LUMINANCE = (0.213, 0.715, 0.072)
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))
HUE_COS = ((0.787, -0.715, -0.072), (-0.213, 0.285, -0.072), (-0.213, -0.715, 0.928))
HUE_SIN = ((-0.213, -0.715, 0.928), (0.143, 0.140, -0.283), (-0.787, 0.715, 0.072))


def filtered(rgba: np.ndarray, brightness: float, contrast: float, saturation: float, hue: float, sepia: float) -> np.ndarray:
    """Brightness, contrast, saturation, hue and sepia in this order on n x 4 bytes; alpha stays."""
    if max(abs(brightness - 1), abs(contrast - 1), abs(saturation - 1), abs(hue), abs(sepia)) < 1e-6:
        return rgba
    rgb = rgba[:, :3].astype(np.float32) / 255 * brightness
    rgb = (rgb - 0.5) * contrast + 0.5
    grey = rgb @ np.array(LUMINANCE, np.float32)[:, None]
    rgb = grey + saturation * (rgb - grey)
    if abs(hue) >= 1e-6:
        turn = np.array(LUMINANCE) + math.cos(math.radians(hue)) * np.array(HUE_COS) + math.sin(math.radians(hue)) * np.array(HUE_SIN)
        rgb = rgb @ turn.astype(np.float32).T
    if sepia > 0:
        rgb = rgb * (1 - sepia) + rgb @ np.array(SEPIA, np.float32).T * sepia
    out = rgba.copy()
    out[:, :3] = np.rint(np.clip(rgb, 0, 1) * 255).astype(np.uint8)
    return out


@F.pandas_udf(T.BinaryType())
def filter_pixels(rgba: pd.Series, brightness: pd.Series, contrast: pd.Series, saturation: pd.Series, hue: pd.Series, sepia: pd.Series) -> pd.Series:
    """Raw RGBA bytes through the filter."""
    return pd.Series([filtered(np.frombuffer(x, np.uint8).reshape(-1, 4), *v).tobytes() for x, *v in zip(rgba, brightness, contrast, saturation, hue, sepia, strict=True)])
