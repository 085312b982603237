"""Reconstruction errors: per-image metrics, reports and training losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoweave.functions.colour import disease_weight
from phenoweave.functions.numeric import psnr
from phenoweave.operators.topk import most_common


def image_metrics(pixels: DataFrame, per_channel: bool = False) -> DataFrame:
    """Masked MSE, MAE, PSNR and per-channel MAE per image.

    ``pixels`` has (image_id, y, x, channel, target, recon, in_mask), channel
    0..2. The sums over three channels are divided by the mask's pixel count of
    one channel; ``per_channel`` divides by all three instead.
    """
    error = F.col("target") - F.col("recon")
    inside = F.col("in_mask")
    channel_pixels = [F.count_if(inside & (F.col("channel") == k)) for k in range(3)]
    mask = channel_pixels[0]
    count = sum(channel_pixels[1:], mask) if per_channel else mask
    total = lambda v, keep: F.coalesce(F.sum(F.when(keep, v)), F.lit(0.0))
    sums = pixels.groupBy("image_id").agg(
        F.try_divide(total(error * error, inside), count).alias("mse"),
        F.try_divide(total(F.abs(error), inside), count).alias("mae"),
        *[
            F.try_divide(total(F.abs(error), inside & (F.col("channel") == k)), mask).alias(name)
            for k, name in enumerate(("L_mae", "a_mae", "b_mae"))
        ],
    )
    return sums.select("image_id", "mse", "mae", psnr(F.col("mse")).alias("psnr"), "L_mae", "a_mae", "b_mae")


def mean_squared_error(pixels: DataFrame) -> DataFrame:
    """Plain mean of squared differences over every entry."""
    error = F.col("target") - F.col("recon")
    return pixels.agg(F.avg(error * error).alias("mse"))


def overall_report(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.avg("mse").alias("mean_mse"),
        F.stddev_pop("mse").alias("std_mse"),
        F.avg("mae").alias("mean_mae"),
        F.avg("psnr").alias("mean_psnr"),
        F.stddev_pop("psnr").alias("std_psnr"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def genotype_report(metrics: DataFrame, k: int = 10) -> DataFrame:
    """Mean errors of the k genotypes with the most images."""
    top = most_common(metrics, "genotype", k).select("genotype")
    return (
        metrics.join(top, "genotype", "left_semi")
        .groupBy("genotype")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("mse").alias("mean_mse"),
            F.avg("psnr").alias("mean_psnr"),
        )
    )


def disease_loss(
    pixels: DataFrame, by: str = "image_id", strength: float = 2.0, mask_weights: bool = True,
    all_pixels: bool = False, uniform: bool = False,
) -> DataFrame:
    """Weighted reconstruction loss and mean weight per image or batch.

    ``pixels`` has one row per pixel: t0..t2 and p0..p2 (target and prediction
    per channel), ``a`` and ``b`` in the target's Lab units, ``in_mask``.
    ``mask_weights`` zeroes the weight outside the mask; ``uniform`` is the
    unweighted form. ``all_pixels`` averages the plain error over every entry.
    """
    squared = sum(
        ((F.col(f"p{k}") - F.col(f"t{k}")) * (F.col(f"p{k}") - F.col(f"t{k}")) for k in range(3)), F.lit(0.0)
    )
    inside = F.col("in_mask")
    if all_pixels:
        return pixels.groupBy(by).agg(
            (F.sum(squared) / (F.count(F.lit(1)) * 3)).alias("reconstruction_loss"),
            F.lit(1.0).alias("mean_weight"),
        )
    if uniform:
        weight = inside.cast("double") if mask_weights else F.lit(1.0)
    else:
        weight = disease_weight(F.col("a"), F.col("b"), strength, inside if mask_weights else None)
    return (
        pixels.select(by, squared.alias("_e"), weight.alias("_w"), inside.alias("_in"))
        .groupBy(by)
        .agg(
            (F.sum(F.col("_e") * F.col("_w")) / (F.sum("_w") + 1e-8)).alias("reconstruction_loss"),
            F.coalesce(F.avg(F.when(F.col("_in"), F.col("_w"))), F.lit(1.0)).alias("mean_weight"),
        )
    )


def add_l1(losses: DataFrame, embeddings: DataFrame, by: str = "image_id", weight: float = 1e-5) -> DataFrame:
    """Add ``l1_loss`` = weight x mean absolute embedding entry, and the total loss."""
    size = embeddings.select(by, F.explode("embedding").alias("_z")).groupBy(by).agg(
        (F.avg(F.abs(F.col("_z").cast("double"))) * weight).alias("l1_loss")
    )
    return (
        losses.join(size, by, "left")
        .withColumn("l1_loss", F.coalesce("l1_loss", F.lit(0.0)))
        .withColumn("total_loss", F.col("reconstruction_loss") + F.col("l1_loss"))
    )
