"""Green runs -> cleaned mask -> components -> two strip boxes per image."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoweave.operators import detection, runs
from phenoweave.operators.strips import number_boxes
from phenoweave.session import durable

_BOX = ["x1", "y1", "x2", "y2"]


def detect_strips(
    green: DataFrame, values: DataFrame, frames: DataFrame, min_area: float = detection.MIN_AREA, max_boxes: int = 2,
    midpoint_fallback: bool = False, clean: bool = True,
) -> DataFrame:
    """(image_id, strip_id, x1, y1, x2, y2): boxes from top to bottom.

    ``green`` holds runs of green pixels, ``values`` the brightness per pixel
    (image_id, y, x, v), ``frames`` the image sizes. A lone candidate is split
    at its midrib, else at a valley; a box enclosing the other one is split at
    its midrib, else in the middle. ``midpoint_fallback`` also halves a lone
    tall box without midrib or valley.
    """
    mask = durable(runs.clean_green_mask(green, frames) if clean else runs.merge_runs(green), "green-mask")
    # Read for the boxes and for the areas.
    outer = durable(runs.components(runs.fill_holes(mask, frames)), "strip-regions")
    heights = frames.select("image_id", F.col("height").alias("image_height"))
    found = durable(
        detection.candidates(runs.contour_features(outer), min_area).join(heights, "image_id"), "strip-candidates"
    )
    chosen = durable(detection.separated(found, k=max_boxes), "strip-choice")

    counts = found.groupBy("image_id").agg(F.count(F.lit(1)).alias("_candidates"))
    picked = chosen.groupBy("image_id").agg(F.count(F.lit(1)).alias("_chosen"))
    lone = (
        chosen.join(counts, "image_id").join(picked, "image_id").filter("_candidates = 1 and _chosen = 1")
        .select("image_id", "image_height", *_BOX)
    )
    pairs = chosen.join(picked.filter("_chosen = 2"), "image_id").select("image_id", "rank", *_BOX)
    nested = detection.nested_outer(detection.pair_boxes(pairs)).select("image_id", "outer.*")

    # Boxes that need a split, with the midrib looked up for both kinds at once.
    to_split = durable(
        lone.select("image_id", "image_height", *_BOX, F.lit(True).alias("_lone")).unionByName(
            nested.join(heights, "image_id").select("image_id", "image_height", *_BOX, F.lit(False).alias("_lone"))
        ).withColumn("box_id", F.lit(0)),
        "strip-splits",
    )
    pixels = values.join(to_split.select("image_id"), "image_id", "left_semi")
    lit = runs.pixels_in_mask(pixels, mask)
    keys = ["image_id", "box_id"]
    smoothed = detection.smooth_gaussian(runs.row_brightness(lit, to_split), keys)
    midrib = detection.midrib_row(smoothed, keys).select("image_id", "midrib_row")
    profile = runs.row_profile(mask, to_split.filter("_lone")).join(
        to_split.select("image_id", (F.col("x2") - F.col("x1")).alias("box_width")), "image_id"
    )
    valley = detection.valley_row(profile, keys).select("image_id", "valley_row")
    planned = durable(
        to_split.join(midrib, "image_id", "left").join(valley, "image_id", "left"), "strip-cuts"
    )

    middle = detection.midpoint(F.col("y1"), F.col("y2"))
    tall = F.col("y2") - F.col("y1") > 0.3 * F.col("image_height")
    cut = F.when(F.col("midrib_row").isNotNull(), F.col("y1") + F.col("midrib_row")).when(
        ~F.col("_lone"), middle
    ).when(F.col("valley_row").isNotNull(), F.col("y1") + F.col("valley_row"))
    if midpoint_fallback:
        cut = cut.when(tall, middle)
    cuts = planned.withColumn("_cut", cut).filter("_cut is not null")
    halves = detection.split_at(
        cuts.filter("midrib_row is not null"), F.col("_cut"), detection.MARGIN
    ).unionByName(detection.split_at(cuts.filter("midrib_row is null"), F.col("_cut")))
    whole = chosen.join(cuts.select("image_id"), "image_id", "left_anti").select("image_id", *_BOX)
    return number_boxes(whole.unionByName(halves.select("image_id", *_BOX)))


def box_counts(images: DataFrame, boxes: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """``images`` with ``num_boxes_detected``: every image, with 0 where no box was found and -1 where it did not decode.

    ``images`` has image_id and image_path, ``unreadable`` the paths that :func:`sources.rasters.failed_rasters` gives.
    """
    found = boxes.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("_boxes"))
    counted = images.join(found, "image_id", "left").withColumn("num_boxes_detected", F.coalesce("_boxes", F.lit(0))).drop("_boxes")
    if unreadable is None:
        return counted
    failed = unreadable.select("image_path").distinct().withColumn("_failed", F.lit(True))
    return counted.join(failed, "image_path", "left").withColumn(
        "num_boxes_detected", F.when(F.col("_failed"), F.lit(-1)).otherwise(F.col("num_boxes_detected"))
    ).drop("_failed")
