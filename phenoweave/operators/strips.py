"""Strip measurements from mask runs and their roll-up to leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from phenoweave.operators.ordering import positions, quantiles
from phenoweave.operators.runs import merge_runs, whole_groups
from phenoweave.session import durable

MASK = ["image_id", "strip_id"]
PIXELS = 1_000_000  # of runs that are laid out at a time

PHENOTYPES = (
    "mean_height_px",
    "median_height_px",
    "min_height_px",
    "max_height_px",
    "height_range_px",
    "area_px",
)


def column_heights(runs: DataFrame) -> DataFrame:
    """(image_id, strip_id, x, height, pixels): vertical extent per occupied column.

    The extent runs from the top to the bottom pixel, holes included. Runs must
    be disjoint per row. The explode feeds a map-side combine on the column, so
    only one row per column and task is shuffled.
    """
    return (
        runs.withColumn("x", F.explode(F.sequence("x_start", "x_end")))
        .groupBy("image_id", "strip_id", "x")
        .agg(
            (F.max("y") - F.min("y") + 1).cast("bigint").alias("height"),
            F.count(F.lit(1)).alias("pixels"),
        )
    )


def _by_height(columns: DataFrame) -> DataFrame:
    return columns.groupBy(*MASK, "height").agg(F.count(F.lit(1)).alias("columns"), F.sum("pixels").alias("pixels"))


def height_counts(runs: DataFrame) -> DataFrame:
    """(image_id, strip_id, height, columns, pixels): :func:`column_heights` counted per height.

    Masks are dealt whole and laid out in tasks, so no row per column is made. Masks with runs of unknown
    row go through :func:`column_heights`.
    """
    runs = durable(runs.select(*MASK, "y", "x_start", "x_end").filter("x_start is not null and x_end is not null"), "strip-runs")
    plain = F.col("y").isNotNull() & (F.col("x_start") <= F.col("x_end"))
    odd = runs.filter(~plain).select(*MASK).distinct()
    known = odd.isEmpty()
    sound = runs if known else runs.join(odd, MASK, "left_anti")

    def count(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero((pdf[MASK] != pdf[MASK].shift()).any(axis=1).to_numpy())
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(pdf)))
        y, left, right = (pdf[c].to_numpy(np.int64) for c in ("y", "x_start", "x_end"))
        low = np.minimum.reduceat(left, starts)
        width = np.maximum.reduceat(right, starts) - low + 2
        base = np.cumsum(width) - width - low
        first, size = left + base[group], right - left + 1
        edges = np.bincount(first, minlength=width.sum()) - np.bincount(first + size, minlength=width.sum())
        top, bottom = np.full(len(edges), -1), np.zeros(len(edges), np.int64)
        taken = np.zeros(len(edges), bool)
        # Rows come from top to bottom: the first to reach a column is its top, the last its bottom.
        for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(size) // PIXELS)) + 1):
            n = size[part]
            cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[part], n)
            line = np.repeat(y[part], n)
            bottom[cell] = line
            fresh = ~taken[cell]
            top[cell[fresh][::-1]] = line[fresh][::-1]
            taken[cell] = True
        held = pd.DataFrame(
            {"g": np.repeat(np.arange(len(starts)), width)[taken], "height": (bottom - top + 1)[taken], "pixels": np.cumsum(edges)[taken]}
        )
        counted = held.groupby(["g", "height"], sort=False)["pixels"].agg(columns="size", pixels="sum").reset_index()
        yield pdf[MASK].iloc[starts[counted["g"]]].reset_index(drop=True).assign(**{c: counted[c] for c in ("height", "columns", "pixels")})

    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in MASK) + ", height bigint, columns bigint, pixels bigint"
    counted = (
        sound.repartition(*MASK).sortWithinPartitions(*MASK, "y")
        .mapInPandas(lambda batches: whole_groups(batches, MASK, count), schema)
    )
    return counted if known else counted.unionByName(_by_height(column_heights(runs.join(odd, MASK, "left_semi"))))


def measure_strips(runs: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Height statistics and area per strip; masks without pixels measure zero.

    Columns are counted per height first, so a strip's median sees one row per
    distinct height, which the image height bounds.
    """
    by_height = height_counts(runs)
    measured = by_height.groupBy("image_id", "strip_id").agg(
        (F.sum(F.col("height") * F.col("columns")) / F.sum("columns")).alias("mean_height_px"),
        F.percentile("height", F.lit(0.5), F.col("columns")).alias("median_height_px"),
        F.min("height").cast("double").alias("min_height_px"),
        F.max("height").cast("double").alias("max_height_px"),
        (F.max("height") - F.min("height")).cast("double").alias("height_range_px"),
        F.sum("pixels").alias("area_px"),
    )
    if masks is None:
        return measured
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint" if c == "area_px" else "double") for c in PHENOTYPES}
    return masks.join(measured, ["image_id", "strip_id"], "left").withColumns(zero)


def measure_masks(runs: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """:func:`measure_strips` of runs that may overlap."""
    return measure_strips(merge_runs(runs, MASK), masks)


def attach_boxes(measurements: DataFrame, boxes: DataFrame) -> DataFrame:
    """Left join of box text and score on (image, strip); absent sidecars stay null."""
    return measurements.join(boxes, ["image_id", "strip_id"], "left")


def corpus_summary(measurements: DataFrame, value: str = "mean_height_px") -> DataFrame:
    """Count, mean, exact median and population deviation over all strips."""
    middle = quantiles(measurements, [], value, {"median_height": 0.5})
    return measurements.agg(
        F.count(value).alias("strips"),
        F.avg(value).alias("mean_height"),
        F.stddev_pop(value).alias("std_height"),
    ).withColumn("median_height", middle.scalar())


def leaf_totals(strips: DataFrame) -> DataFrame:
    """Sum of phenotypes and score over a leaf's strips; all-null sums are zero."""
    columns = [*PHENOTYPES, "sam_score"]
    return strips.groupBy("image_name", "device", "genotype", "row", "range").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]
    )


def number_boxes(boxes: DataFrame) -> DataFrame:
    """Strip ids from top to bottom within an image, starting at zero."""
    return positions(boxes, ["image_id"], ["y1", "x1", "y2", "x2"], "strip_id")
