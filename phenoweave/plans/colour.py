"""Colour path: patches -> fits -> corrected patches -> scores; channel statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phenoweave.functions.colour import background_zero, zscore
from phenoweave.operators.colourfit import (
    CARD,
    STRAIGHT,
    apply_transform,
    card_pixels,
    cards,
    fit,
    fit_each,
    mean_delta_e_each,
    patch_means,
    window_means,
)
from phenoweave.session import durable

COMPARED = ("linear", "polynomial2", "polynomial3", "cheung2004", "finlayson2015", "vandermonde")


def compare_methods(patches: DataFrame, methods: Sequence[str] = COMPARED) -> DataFrame:
    """Mean colour difference per image and method, the uncorrected one included.

    Patches are corrected as means; correcting only them keeps the pixels of the
    photographs out of the plan. The patches of an image meet once, for all methods.
    """
    measured = cards(patches)
    compared = {"original": measured}
    for method, fitted in fit_each(measured, methods).items():
        compared[method] = apply_transform(measured, fitted, method)
    return mean_delta_e_each(compared)


def compare_methods_on_pixels(
    pixels: DataFrame, frames: DataFrame, methods: Sequence[str] = COMPARED, card: dict = CARD, straight: dict = STRAIGHT
) -> DataFrame:
    """As :func:`compare_methods`, re-measuring the patches on corrected pixels.

    The photographs are read once: only pixels inside the card's windows are
    kept, corrected by each method and measured again.
    """
    inside = durable(card_pixels(pixels, frames, card, straight), "card-pixels")
    measured = durable(window_means(inside), "card-patches")
    compared = {"original": measured}
    for method, fitted in fit_each(measured, methods).items():
        compared[method] = window_means(apply_transform(inside, fitted, method))
    return mean_delta_e_each(compared)


def normalise_images(pixels: DataFrame, frames: DataFrame, method: str = "linear", card: dict = CARD, straight: dict = STRAIGHT) -> DataFrame:
    """Measure the card, fit per image, correct every pixel."""
    return apply_transform(pixels, fit(patch_means(pixels, frames, card, straight), method), method)


def channel_statistics(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean and population deviation per channel over masked pixels, one row."""
    inside = pixels.filter("in_mask")
    return inside.agg(
        *[f(c).alias(f"{n}_{c}") for c in channels for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
        F.count(F.lit(1)).alias("pixels"),
    )


def normalise_lab(pixels: DataFrame, statistics: DataFrame, channels: Sequence[str], keep_background: bool = False) -> DataFrame:
    """z-scores with one-row statistics; the background is zeroed unless kept."""
    packed = statistics.select(F.struct(*[f"{n}_{c}" for c in channels for n in ("mean", "std")]).alias("s"))
    out = pixels.withColumn("_s", packed.scalar())
    scaled = {
        c: background_zero(zscore(F.col(c), F.col("_s")[f"mean_{c}"], F.col("_s")[f"std_{c}"]), F.col("in_mask"), keep_background)
        for c in channels
    }
    return out.withColumns(scaled).drop("_s")
