"""Image tree -> box gate -> strip measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoweave.operators.catalog import classify_boxes, pending, reusable
from phenoweave.operators import strips
from phenoweave.operators.strips import attach_boxes
from phenoweave.schemas import MEASUREMENT_COLUMNS


def measure_masks(masks: DataFrame, runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Measurement table of decoded masks (image_id, strip_id) with their sidecars."""
    measured = strips.measure_masks(runs, masks.select("image_id", "strip_id"))
    return attach_boxes(measured, boxes).withColumn("image_name", F.col("image_id")).select(
        "image_id", *MEASUREMENT_COLUMNS
    )


def gate(images: DataFrame, done: DataFrame, detections: DataFrame, min_boxes: int = 2, max_boxes: int = 2) -> DataFrame:
    """Classified box counts of the images that still need work; one without a count has no box."""
    counted = pending(images, done).select("image_id").join(detections, "image_id", "left")
    return classify_boxes(counted.withColumn("num_boxes_detected", F.coalesce("num_boxes_detected", F.lit(0))), min_boxes, max_boxes)


def all_measurements(new: DataFrame, earlier: DataFrame, images: DataFrame) -> DataFrame:
    """New measurements plus the reused ones of images measured before."""
    kept = reusable(earlier, images).join(new.select("image_id").distinct(), "image_id", "left_anti")
    return new.unionByName(kept)
