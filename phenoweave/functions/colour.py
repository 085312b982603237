"""Colour conversions and pixel arithmetic as generated Column expressions.

The DataFrame forms add columns in a few projections, so shared terms are
computed once per pixel and the whole chain stays in one codegen stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Linear sRGB -> XYZ (D65), its inverse, and the D65 white point.
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
XYZ_TO_RGB = (
    (3.240479, -1.537150, -0.498535),
    (-0.969256, 1.875991, 0.041556),
    (0.055648, -0.204043, 1.057311),
)
WHITE = (0.950456, 1.0, 1.088754)

# Healthy-leaf centres in CIE Lab and the score's scale.
HEALTHY_A = -30.0
HEALTHY_B = 30.0
DEVIATION_SCALE = 50.0

# Image-net channel means and standard deviations.
CHANNEL_MEAN = {"r": 0.485, "g": 0.456, "b": 0.406}
CHANNEL_STD = {"r": 0.229, "g": 0.224, "b": 0.225}

# hue/saturation/value bounds of leaf green, inclusive.
GREEN_LOW = (35, 40, 40)
GREEN_HIGH = (85, 255, 255)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit HSV: hue in half degrees 0..179, saturation and value 0..255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = (top - low).cast("double")
    sector = (
        F.when(top == low, F.lit(0.0))
        .when(top == r, 60.0 * F.try_divide(g - b, spread))
        .when(top == g, 120.0 + 60.0 * F.try_divide(b - r, spread))
        .otherwise(240.0 + 60.0 * F.try_divide(r - g, spread))
    )
    degrees = F.when(sector < 0, sector + 360.0).otherwise(sector)
    half = F.floor(degrees / 2.0 + 0.5)
    hue = F.when(half >= 180, half - 180).otherwise(half).cast("int")
    saturation = F.coalesce(F.floor(F.try_divide(spread * 255.0, top) + 0.5), F.lit(0)).cast("int")
    return hue, saturation, top.cast("int")


def is_green(h: Column, s: Column, v: Column, low=GREEN_LOW, high=GREEN_HIGH) -> Column:
    return h.between(low[0], high[0]) & s.between(low[1], high[1]) & v.between(low[2], high[2])


def _linear(channel: Column) -> Column:
    unit = channel / 255.0
    return F.when(unit <= 0.04045, unit / 12.92).otherwise(F.pow((unit + 0.055) / 1.055, F.lit(2.4)))


def _lab_f(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)


def add_lab(df: DataFrame, r: str, g: str, b: str, out=("L", "a", "b_"), encoding: str = "cie") -> DataFrame:
    """Add Lab columns of 0..255 sRGB columns.

    ``cie`` gives L in 0..100 and signed a/b; ``opencv8`` gives rounded 8-bit
    values (L scaled by 255/100, a and b shifted by 128).
    """
    if encoding not in ("cie", "opencv8"):
        raise ValueError(f"unknown Lab encoding: {encoding}")
    step = df.select(
        "*",
        _linear(F.col(r)).alias("_lr"),
        _linear(F.col(g)).alias("_lg"),
        _linear(F.col(b)).alias("_lb"),
    )
    step = step.select(
        "*",
        *[
            _lab_f(
                (F.col("_lr") * row[0] + F.col("_lg") * row[1] + F.col("_lb") * row[2]) / WHITE[i]
            ).alias(f"_f{i}")
            for i, row in enumerate(RGB_TO_XYZ)
        ],
    )
    light = 116.0 * F.col("_f1") - 16.0
    red_green = 500.0 * (F.col("_f0") - F.col("_f1"))
    yellow_blue = 200.0 * (F.col("_f1") - F.col("_f2"))
    if encoding == "opencv8":
        clip8 = lambda c: F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(255)).cast("int")
        light, red_green, yellow_blue = (
            clip8(light * 2.55),
            clip8(red_green + 128.0),
            clip8(yellow_blue + 128.0),
        )
    return step.select(
        *df.columns, light.alias(out[0]), red_green.alias(out[1]), yellow_blue.alias(out[2])
    )


def lab_values(rgb: np.ndarray) -> np.ndarray:
    """:func:`add_lab` for arrays in tasks: CIE Lab of 0..255 sRGB colours, channels along the first axis."""
    unit = rgb / 255.0
    linear = np.where(unit <= 0.04045, unit / 12.92, ((np.maximum(unit, 0.0) + 0.055) / 1.055) ** 2.4)
    t = (np.array(RGB_TO_XYZ) / np.array(WHITE)[:, None]) @ linear
    x, y, z = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16.0 / 116.0)
    return np.stack([116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)])


def add_rgb_from_lab(
    df: DataFrame, light: str, a: str, b: str, out=("r", "g", "b"), encoding: str = "cie",
    clip_light: bool = True,
) -> DataFrame:
    """Inverse of :func:`add_lab`, truncated to 0..255 integers.

    ``clip_light`` limits L to 100 and a/b to -128..127 first, as is right for
    CIE values and lossy for 8-bit ones.
    """
    l_in, a_in, b_in = F.col(light).cast("double"), F.col(a).cast("double"), F.col(b).cast("double")
    if clip_light:
        l_in = F.least(F.greatest(l_in, F.lit(0.0)), F.lit(100.0))
        a_in = F.least(F.greatest(a_in, F.lit(-128.0)), F.lit(127.0))
        b_in = F.least(F.greatest(b_in, F.lit(-128.0)), F.lit(127.0))
    if encoding == "opencv8":
        # 8-bit values are whole numbers.
        l_in, a_in, b_in = F.floor(l_in) * (100.0 / 255.0), F.floor(a_in) - 128.0, F.floor(b_in) - 128.0
    step = df.select("*", ((l_in + 16.0) / 116.0).alias("_fy"), a_in.alias("_a"), b_in.alias("_b"))
    unf = lambda t: F.when(t > 6.0 / 29.0, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787)
    step = step.select(
        "*",
        (unf(F.col("_fy") + F.col("_a") / 500.0) * WHITE[0]).alias("_x"),
        unf(F.col("_fy")).alias("_y"),
        (unf(F.col("_fy") - F.col("_b") / 200.0) * WHITE[2]).alias("_z"),
    )
    channels = []
    for row, name in zip(XYZ_TO_RGB, out):
        lin = F.col("_x") * row[0] + F.col("_y") * row[1] + F.col("_z") * row[2]
        lin = F.least(F.greatest(lin, F.lit(0.0)), F.lit(1.0))
        unit = F.when(lin <= 0.0031308, lin * 12.92).otherwise(
            1.055 * F.pow(lin, F.lit(1.0 / 2.4)) - 0.055
        )
        channels.append(F.floor(unit * 255.0 + 0.5).cast("int").alias(name))
    return step.select(*df.columns, *channels)


def delta_e(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """CIE76 colour difference of two Lab triples."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / (std + 1e-8)


def unzscore(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def normalise_channel(value: Column, channel: str) -> Column:
    """0..255 -> unit scale -> fixed mean and standard deviation."""
    return (value / 255.0 - CHANNEL_MEAN[channel]) / CHANNEL_STD[channel]


def denormalise_channel(value: Column, channel: str) -> Column:
    unit = value * CHANNEL_STD[channel] + CHANNEL_MEAN[channel]
    return F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0))


def background_zero(value: Column, in_mask: Column, keep_background: bool = False) -> Column:
    """Zero outside the mask, or unchanged when the crop keeps its background."""
    return value if keep_background else F.when(in_mask, value).otherwise(F.lit(0.0))


def disease_weight(a: Column, b: Column, strength: float = 2.0, in_mask: Column | None = None) -> Column:
    """1 for healthy green up to ``strength`` for red- or yellow-shifted pixels."""
    red = F.greatest(a - HEALTHY_A, F.lit(0.0)) / DEVIATION_SCALE
    yellow = F.greatest(b - HEALTHY_B, F.lit(0.0)) / DEVIATION_SCALE
    score = F.least(F.greatest(red + yellow, F.lit(0.0)), F.lit(1.0))
    weight = 1.0 + score * (strength - 1.0)
    return weight if in_mask is None else F.when(in_mask, weight).otherwise(F.lit(0.0))


def rgb_from_bgr(pixel: Column) -> Column:
    """Struct (c0, c1, c2) in blue-green-red order -> struct r, g, b."""
    return F.struct(pixel["c2"].alias("r"), pixel["c1"].alias("g"), pixel["c0"].alias("b"))


def to_byte(value: Column) -> Column:
    """Clip to 0..255 and drop the fraction."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("int")


def rotate_clockwise(y: Column, x: Column, height: Column) -> tuple[Column, Column]:
    """Coordinates after a 90 degree clockwise turn of an image of ``height`` rows."""
    return x, height - 1 - y
