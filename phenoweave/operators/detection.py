"""Choosing and splitting strip boxes from scored components.

Row profiles are (keys, row, value) with one row per raster row, so a window
over one box is bounded by the raster's height.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoweave.operators.packing import in_order, map_groups, pack

MIN_AREA = 5000
SEPARATION = 0.1
MARGIN = 0.02
MIDRIB_FACTOR = 1.05
PROMINENCE = 0.1
SIGNAL_CELLS = 50_000  # rows of equally long signals that are weighted together


def candidate_score(area: Column, aspect: Column, extent: Column) -> Column:
    """Area weighted by shape: wide x1.5, filled x1.3, large x1.2."""
    return (
        area.cast("double")
        * F.when(aspect > 2, 1.5).otherwise(1.0)
        * F.when(extent > 0.5, 1.3).otherwise(1.0)
        * F.when(area > 50000, 1.2).otherwise(1.0)
    )


def candidates(features: DataFrame, min_area: float = MIN_AREA) -> DataFrame:
    """Components above the area threshold with box corners and score."""
    return features.filter(F.col("area") > min_area).select(
        "*",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        (F.col("x") + F.col("w")).alias("x2"),
        (F.col("y") + F.col("h")).alias("y2"),
        candidate_score(F.col("area"), F.col("aspect_ratio"), F.col("extent")).alias("score"),
    )


def _preference(df: DataFrame) -> Column:
    """Comparable struct: higher score first, then the smaller y1, x1."""
    return F.struct(F.col("score"), -F.col("y1"), -F.col("x1"), -F.col("y2"), -F.col("x2"))


def top_boxes(boxes: DataFrame, k: int = 2, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The k best boxes per image; each task keeps k rows per image before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(F.desc("score"), "y1", "x1", "y2", "x2")
    return boxes.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= k)


def separated(
    boxes: DataFrame, k: int = 2, separation: float = SEPARATION, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Greedy choice of k boxes at least ``separation`` image heights apart.

    Round i takes the best remaining box per image with an aggregate and drops
    the boxes too close to it, which is the sequential rule unrolled k times;
    no image's boxes are ever sorted in one place. Needs ``image_height``.
    """
    keys = list(keys)
    columns = boxes.columns
    remaining, chosen = boxes, None
    for rank in range(1, k + 1):
        best = remaining.groupBy(*keys).agg(F.max_by(F.struct(*columns), _preference(remaining)).alias("_best"))
        picked = best.select(*[F.col("_best")[c].alias(c) for c in columns], F.lit(rank).alias("rank"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        if rank < k:
            near = best.select(*keys, F.col("_best")["centroid_y"].alias("_cy"))
            remaining = (
                remaining.join(near, keys)
                .filter(F.abs(F.col("centroid_y") - F.col("_cy")) >= separation * F.col("image_height"))
                .drop("_cy")
            )
    return chosen


def pair_boxes(chosen: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per image: structs box1 and box2 by rank, and the number chosen."""
    box = F.struct("x1", "y1", "x2", "y2")
    return chosen.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, box)).alias("box1"),
        F.max(F.when(F.col("rank") == 2, box)).alias("box2"),
        F.count(F.lit(1)).alias("n_boxes"),
    )


def contains(outer: Column, inner: Column) -> Column:
    return (
        (inner["x1"] >= outer["x1"])
        & (inner["x2"] <= outer["x2"])
        & (inner["y1"] >= outer["y1"])
        & (inner["y2"] <= outer["y2"])
    )


def nested_outer(pairs: DataFrame) -> DataFrame:
    """Images whose two boxes nest, with the enclosing box as ``outer``."""
    first, second = F.col("box1"), F.col("box2")
    return pairs.select(
        "*", F.when(contains(first, second), first).when(contains(second, first), second).alias("outer")
    ).filter("outer is not null")


def gaussian_weights(sigma: float = 5.0, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth_gaussian(
    profile: DataFrame, keys: Sequence[str], row: str = "row", value: str = "brightness",
    name: str = "smoothed", sigma: float = 5.0,
) -> DataFrame:
    """Gaussian smoothing along dense rows 0..n-1 with half-sample reflection.

    Signals are dealt whole, packed, a value per raster row, and equally long
    ones are weighted together, in one shuffle.
    """
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in profile.schema.fields}
    names = profile.columns

    def smooth(heads: pa.RecordBatch, sizes: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        place = in_order(sizes, columns[row].to_numpy(zero_copy_only=False))
        if place is not None:
            columns = {c: v.take(pa.array(place)) for c, v in columns.items()}
        values, out = columns[value].to_numpy(zero_copy_only=False).astype(float), np.empty(sizes.sum())
        starts = np.cumsum(sizes) - sizes
        for n in np.unique(sizes):
            # The place of a mirrored row inside the signal.
            turn = np.arange(-radius, n + radius) % (2 * n)
            turn = np.where(turn < n, turn, 2 * n - 1 - turn)
            chosen = starts[sizes == n]
            for part in np.array_split(chosen, -(-len(chosen) * n // SIGNAL_CELLS)):
                cells = part[:, None] + np.arange(n)
                signal = values[cells].T[turn]
                total = np.zeros((n, len(part)))
                for k, w in enumerate(weights):
                    total += signal[k : k + n] * w
                out[cells] = total.T
        group = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        whole = {**{k: heads.column(k).take(group) for k in keys}, **columns}
        return pa.RecordBatch.from_arrays([*[whole[c] for c in names], pa.array(out)], names=[*names, name])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{name}` double"
    return map_groups(pack(profile, keys), keys, smooth, schema)


def smooth_mean(
    profile: DataFrame, keys: Sequence[str], row: str = "row", value: str = "brightness",
    name: str = "smoothed", size: int = 11,
) -> DataFrame:
    """Moving mean with zeros beyond both ends."""
    frame = Window.partitionBy(*keys).orderBy(row).rowsBetween(-(size // 2), size // 2)
    return profile.withColumn(name, F.sum(value).over(frame) / size)


def middle_third(profile: DataFrame, keys: Sequence[str], row: str = "row") -> DataFrame:
    """Rows n//3 .. 2n//3 - 1 of each dense profile."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (
        profile.withColumn("_n", n)
        .filter((F.col(row) >= F.floor(F.col("_n") / 3)) & (F.col(row) < F.floor(2 * F.col("_n") / 3)))
        .drop("_n")
    )


def midrib_row(
    smoothed: DataFrame, keys: Sequence[str], row: str = "row", value: str = "smoothed",
    factor: float = MIDRIB_FACTOR,
) -> DataFrame:
    """Brightest row of the middle third, if clearly above the mean of lit rows."""
    # One shuffle: a box's rows, which the raster bounds, are counted where they meet.
    box = Window.partitionBy(*keys)
    counted = smoothed.withColumns(
        {"_n": F.count(F.lit(1)).over(box), "_mean": F.avg(F.when(F.col(value) > 0, F.col(value))).over(box)}
    )
    middle = (F.col(row) >= F.floor(F.col("_n") / 3)) & (F.col(row) < F.floor(2 * F.col("_n") / 3))
    return (
        counted.filter(middle)
        .groupBy(*keys)
        .agg(
            F.max(F.struct(F.col(value).alias("v"), (-F.col(row)).alias("r"))).alias("_peak"),
            F.max("_mean").alias("_mean"),
        )
        .filter(F.col("_peak")["v"] > F.coalesce("_mean", F.lit(0.0)) * factor)
        .select(*keys, (-F.col("_peak")["r"]).cast("int").alias("midrib_row"))
    )


def _prominent_peaks(signal: np.ndarray, minimum: float) -> list[int]:
    """Middles of flat local maxima whose drop on both sides reaches ``minimum``."""
    edges = np.flatnonzero(np.diff(signal) != 0)
    starts = np.concatenate(([0], edges + 1))
    stops = np.concatenate((edges, [len(signal) - 1]))
    levels = signal[starts]
    found = []
    for k in range(1, len(levels) - 1):
        if not (levels[k - 1] < levels[k] > levels[k + 1]):
            continue
        higher_left = np.flatnonzero(levels[:k] > levels[k])
        higher_right = np.flatnonzero(levels[k + 1 :] > levels[k])
        left = levels[higher_left[-1] + 1 if len(higher_left) else 0 : k]
        right = levels[k + 1 : k + 1 + higher_right[0] if len(higher_right) else len(levels)]
        if levels[k] - max(left.min(), right.min()) >= minimum:
            found.append(int(starts[k] + stops[k]) // 2)
    return found


def _middle_valleys(signal: np.ndarray, sizes: np.ndarray, minimum: np.ndarray) -> np.ndarray:
    """Per signal the middle one of its prominent peaks, or -1; flat signals have none."""
    starts = np.cumsum(sizes) - sizes
    # A peak needs a fall of the minimum inside the signal: most signals are too flat to be searched.
    fall = np.maximum.reduceat(signal, starts) - np.minimum.reduceat(signal, starts)
    found = np.full(len(sizes), -1)
    for at in np.flatnonzero(~(fall < minimum)):
        peaks = _prominent_peaks(signal[starts[at] : starts[at] + sizes[at]], minimum[at])
        if peaks:
            found[at] = peaks[len(peaks) // 2]
    return found


def valley_row(
    profile: DataFrame, keys: Sequence[str], width: str = "box_width", row: str = "row", value: str = "pixels",
    prominence: float = PROMINENCE,
) -> DataFrame:
    """Middle valley of the row projection with enough prominence, per box.

    Projections are dealt whole, packed, at most one value per raster row; many
    boxes are searched in each Arrow batch.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in profile.schema.fields}

    def pick(heads: pa.RecordBatch, sizes: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        place = in_order(sizes, columns[row].to_numpy(zero_copy_only=False))
        if place is not None:
            columns = {c: v.take(pa.array(place)) for c, v in columns.items()}
        starts = np.cumsum(sizes) - sizes
        signals, across = (columns[c].to_numpy(zero_copy_only=False).astype(float) for c in (value, width))
        found = _middle_valleys(-signals, sizes, np.fmax.reduceat(across, starts) * prominence)
        kept = np.flatnonzero(found >= 0)
        return pa.RecordBatch.from_arrays(
            [*[heads.column(k).take(pa.array(kept)) for k in keys], pa.array(found[kept].astype(np.int32))], names=[*keys, "valley_row"]
        )

    # Projections are dense, so the position in the signal is the row.
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["valley_row int"])
    return map_groups(pack(profile.select(*keys, row, value, width), keys), keys, pick, schema)


def split_at(boxes: DataFrame, split_y: Column, margin: float = 0.0, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Two boxes above and below ``split_y``, pulled apart by a share of the box height."""
    gap = F.floor((F.col("y2") - F.col("y1")) * margin)
    top = F.struct(
        F.lit(0).alias("strip_id"), F.col("x1"), F.col("y1"), F.col("x2"),
        F.greatest(F.col("y1"), split_y - gap).cast("int").alias("y2"),
    )
    bottom = F.struct(
        F.lit(1).alias("strip_id"), F.col("x1"),
        F.least(F.col("y2"), split_y + gap).cast("int").alias("y1"), F.col("x2"), F.col("y2"),
    )
    half = boxes.withColumn("_half", F.explode(F.array(_cast_box(top), _cast_box(bottom))))
    return half.select(*keys, *[F.col("_half")[c].alias(c) for c in ("strip_id", "x1", "y1", "x2", "y2")])


def _cast_box(box: Column) -> Column:
    return box.cast("struct<strip_id:int,x1:int,y1:int,x2:int,y2:int>")


def midpoint(y1: Column, y2: Column) -> Column:
    return F.floor((y1 + y2) / 2).cast("int")
