"""Run-length mask algebra: union, morphology, components, pixel tests.

A mask is a table of horizontal runs (keys, y, x_start, x_end), both ends
inclusive. Every shuffle key starts with the image and includes the row (and,
for interval joins, a block of columns), so a single huge image still spreads
over the cluster and the rows of one group are bounded by the raster's width.
``frames`` is (keys, width, height), one row per image.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from phenoweave.operators.graph import connected_components
from phenoweave.session import durable

BLOCK = 64


def merge_runs(runs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Union of overlapping or touching runs per image row (gaps and islands).

    The first aggregate keeps one run per start, so a row of the image has at
    most as many runs as it has columns before the window sees it. The rows are
    dealt once, before it: few runs share a start, so combining them earlier
    would only hold a task's whole input in memory.
    """
    row = [*keys, "y"]
    longest = runs.repartition(*row).groupBy(*row, "x_start").agg(F.max("x_end").alias("x_end"))
    ordered = Window.partitionBy(*row).orderBy("x_start")
    reach = F.max("x_end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return (
        longest.withColumn("_new", F.coalesce((F.col("x_start") > reach + 1).cast("int"), F.lit(1)))
        .withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*row, "_island")
        .agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end"))
        .select(*row, "x_start", "x_end")
    )


def union_masks(*masks: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Logical OR of masks."""
    stacked = masks[0].select(*keys, "y", "x_start", "x_end")
    for other in masks[1:]:
        stacked = stacked.unionByName(other.select(*keys, "y", "x_start", "x_end"))
    return merge_runs(stacked, keys)


def complement(runs: DataFrame, frames: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Background runs of merged ``runs`` inside the frame, empty rows included."""
    row = [*keys, "y"]
    sentinel = frames.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"),
        F.col("width").cast("bigint").alias("x_start"),
        F.col("width").cast("bigint").alias("x_end"),
    )
    typed = runs.select(
        *keys, F.col("y").cast("int").alias("y"),
        F.col("x_start").cast("bigint").alias("x_start"), F.col("x_end").cast("bigint").alias("x_end"),
    )
    ordered = Window.partitionBy(*row).orderBy("x_start")
    return (
        typed.unionByName(sentinel)
        .withColumn("_from", F.coalesce(F.lag("x_end").over(ordered) + 1, F.lit(0).cast("bigint")))
        .filter(F.col("_from") < F.col("x_start"))
        .select(*row, F.col("_from").alias("x_start"), (F.col("x_start") - 1).alias("x_end"))
    )


def _grown(runs: DataFrame, frames: DataFrame, rx: int, ry: int, keys: Sequence[str]) -> DataFrame:
    """Dilation with one copy of a run per row it reaches, for runs of any kind."""
    size = frames.select(*keys, F.col("width").alias("_w"), F.col("height").alias("_h"))
    grown = (
        runs.join(size, list(keys))
        .select(
            *keys,
            F.explode(
                F.sequence(
                    F.greatest(F.col("y") - ry, F.lit(0)).cast("int"),
                    F.least(F.col("y") + ry, F.col("_h") - 1).cast("int"),
                )
            ).alias("y"),
            F.greatest(F.col("x_start") - rx, F.lit(0)).cast("bigint").alias("x_start"),
            F.least(F.col("x_end") + rx, F.col("_w") - 1).cast("bigint").alias("x_end"),
        )
    )
    return merge_runs(grown, keys)


def _sized(runs: DataFrame, frames: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(runs inside their frames with ``_w`` and ``_h``, all runs, keys of other images or None), written once.

    An image with a null bound or a run beyond its frame is one of the others as a whole. Frames grow with the images,
    so neither side may be broadcast by estimate.
    """
    size = frames.select(*keys, F.col("width").cast("int").alias("_w"), F.col("height").cast("int").alias("_h"))
    written = durable(runs.select(*keys, "y", "x_start", "x_end").join(size.hint("merge"), list(keys)), "mask-runs")
    inside = F.col("y").between(0, F.col("_h") - 1) & (F.col("x_start") >= 0) & (F.col("x_start") <= F.col("x_end")) & (F.col("x_end") < F.col("_w"))
    odd = written.filter(~F.coalesce(inside, F.lit(False))).select(*keys).distinct()
    if odd.isEmpty():
        return written, written, None
    return written.join(odd, list(keys), "left_anti"), written, odd


def _morph(runs: DataFrame, frames: DataFrame, step: str, width: int, height: int, iterations: int, keys: Sequence[str]) -> DataFrame:
    """One morphological step: in bands of cells where the mask lies in its frame, run by run elsewhere."""
    keys = list(keys)
    sound, written, odd = _sized(runs, frames, keys)
    out = _filter_runs(sound, keys, ((step, width, height, iterations),))
    if odd is None:
        return out
    rest = written.join(odd, keys, "left_semi").select(*keys, "y", "x_start", "x_end")
    mine = frames.join(odd, keys, "left_semi")
    rx, ry = (width // 2) * iterations, (height // 2) * iterations
    for grow in STEPS[step]:
        if grow:
            rest = _grown(rest, mine, rx, ry, keys)
        else:
            rest = complement(_grown(complement(rest, mine, keys), mine, rx, ry, keys), mine, keys)
    return out.unionByName(rest.select(*[F.col(c).cast(out.schema[c].dataType).alias(c) for c in out.columns]))


def dilate(
    runs: DataFrame, frames: DataFrame, width: int, height: int, iterations: int = 1,
    keys: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Dilation by a centred rectangle; repeated dilations are one larger rectangle."""
    return _morph(runs, frames, "dilate", width, height, iterations, keys)


def erode(
    runs: DataFrame, frames: DataFrame, width: int, height: int, iterations: int = 1,
    keys: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Erosion by a centred rectangle; pixels outside the frame do not erode."""
    return _morph(runs, frames, "erode", width, height, iterations, keys)


def close(runs, frames, width: int, height: int, iterations: int = 1, keys=("image_id",)) -> DataFrame:
    return _morph(runs, frames, "close", width, height, iterations, keys)


def open_(runs, frames, width: int, height: int, iterations: int = 1, keys=("image_id",)) -> DataFrame:
    return _morph(runs, frames, "open", width, height, iterations, keys)


# Whether each part of a step grows the mask or the background.
STEPS = {"close": (True, False), "open": (False, True), "dilate": (True,), "erode": (False,)}

# Cleaning of a green mask: (step, kernel width, kernel height, iterations).
CLEANING = (("close", 15, 15, 2), ("close", 25, 5, 1), ("open", 5, 5, 1))
TILE_HEIGHT = 256


TILE_CELLS = 16_000_000  # of bands that are held at a time, a bit for each


def whole_groups(batches: Iterator[pd.DataFrame], group: list[str], work) -> Iterator[pd.DataFrame]:
    """Feed ``work`` frames of complete groups from batches sorted by group.

    The last group of a batch may go on in the next one, so it is held back;
    the groups here (bands of a mask) are bounded.
    """
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = (pdf[group] == pdf[group].iloc[-1]).all(axis=1).to_numpy()
        held = pdf[last]
        if not last.all():
            yield from work(pdf[~last].reset_index(drop=True))
    if held is not None and len(held):
        yield from work(held.reset_index(drop=True))


def _near(mask: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Whether any cell within ``radius`` along ``axis`` is set (for words: each of their cells), by doubling the window."""
    if not radius:
        return mask
    margin = [(radius, radius) if k == axis else (0, 0) for k in range(mask.ndim)]
    wide, span, whole = np.pad(mask, margin), 1, 2 * radius + 1
    upto = lambda array, start, stop: array[tuple(slice(start, stop) if k == axis else slice(None) for k in range(mask.ndim))]
    while span < whole:
        # A window of ``span`` cells and the one that ends the new window.
        step = min(span, whole - span)
        wide = upto(wide, 0, -step) | upto(wide, step, None)
        span += step
    return wide


def _later(words: np.ndarray, step: int) -> np.ndarray:
    """Every cell moved ``step`` columns to the right; ``words[i]`` holds columns 64 i to 64 i + 63 of all rows."""
    whole, part = divmod(step, 64)
    out = np.zeros_like(words)
    kept = words[: len(words) - whole]
    out[whole:] = kept << part
    if part:
        out[whole + 1 :] |= kept[:-1] >> (64 - part)
    return out


def _earlier(words: np.ndarray, step: int) -> np.ndarray:
    """Every cell moved ``step`` columns to the left."""
    whole, part = divmod(step, 64)
    out = np.zeros_like(words)
    kept, size = words[whole:], len(words) - whole
    out[:size] = kept >> part
    if part:
        out[: size - 1] |= kept[1:] << (64 - part)
    return out


def _beside(words: np.ndarray, radius: int) -> np.ndarray:
    """Whether any cell within ``radius`` along the row is set; the words have room for twice the radius."""
    span, whole = 1, 2 * radius + 1
    while span < whole:
        step = min(span, whole - span)
        words = words | _later(words, step)
        span += step
    return _earlier(words, radius) if radius else words


def _fill_words(row: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int, width: int, room: int) -> np.ndarray:
    """(word, row) with the cells of the runs set, the first column in the lowest bit."""
    size = (width + room + 63) // 64
    start, end = np.maximum(start, 0), np.minimum(end, width - 1)
    kept = start <= end
    row, start, end = row[kept], start[kept], end[kept]
    n = (end >> 6) - (start >> 6) + 1
    run = np.repeat(np.arange(len(n)), n)
    word = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + (start >> 6)[run]
    low, high = np.maximum(start[run] - word * 64, 0), np.minimum(end[run] - word * 64, 63)
    full = np.uint64(2**64 - 1)
    cells = (full << low.astype(np.uint64)) & (full >> (63 - high).astype(np.uint64))
    at = word * rows + row[run]
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.zeros(size * rows, np.uint64)
    if len(first):
        out[at[first]] = np.bitwise_or.reduceat(cells[order], first)
    return out.reshape(size, rows)


def _set_cells(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the set cells, in order of rows."""
    flat = words.reshape(len(words), -1).T.ravel()
    held = np.flatnonzero(flat)
    which, bit = np.nonzero(np.unpackbits(flat[held].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    row, word = np.divmod(held[which], len(words))
    return row, word * 64 + bit


def _filter_words(bands: np.ndarray, steps, width: int) -> np.ndarray:
    """Apply the steps to a stack of equally sized bands (word, band, row)."""
    one = np.zeros(1, int)
    frame = _fill_words(one, one, one + width - 1, 1, width, len(bands) * 64 - width)[:, :, None]
    for step, w, h, n in steps:
        rx, ry = (w // 2) * n, (h // 2) * n
        for grow in STEPS[step]:
            bands = bands if grow else ~bands & frame
            bands = _near(_beside(bands, rx) & frame, ry, 2)
            bands = bands if grow else ~bands & frame
    return bands


def _filter_bands(bands: np.ndarray, steps) -> np.ndarray:
    """:func:`_filter_words` on cells (band, row, column)."""
    count, rows, width = bands.shape
    line, column = np.nonzero(bands.reshape(-1, width))
    room = 2 * max((w // 2) * n for _, w, _, n in steps)
    words = _fill_words(line, column, column, count * rows, width, room).reshape(-1, count, rows)
    out = np.zeros((count * rows, width), bool)
    out[_set_cells(_filter_words(words, steps, width))] = True
    return out.reshape(bands.shape)


def clean_green_mask(
    runs: DataFrame, frames: DataFrame, keys=("image_id",), steps=CLEANING, tile_height: int = TILE_HEIGHT
) -> DataFrame:
    """Closing 15x15 twice, closing 25x5, opening 5x5, in one shuffle.

    Equal to chaining :func:`close` and :func:`open_`. The image is cut into
    bands of rows that overlap by the reach of all steps together; a band of
    bounded size is filled in, filtered and encoded again inside a task. Bands
    without runs do not exist, as none of the steps makes something of nothing.
    """
    size = frames.select(*keys, F.col("width").cast("int").alias("_w"), F.col("height").cast("int").alias("_h"))
    single = runs.groupBy(*keys, "y", "x_start").agg(F.max("x_end").alias("x_end"))
    return _filter_runs(single.join(size, list(keys)), list(keys), steps, tile_height)


def _filter_runs(sized: DataFrame, keys: list[str], steps, tile_height: int = TILE_HEIGHT) -> DataFrame:
    """The steps on runs inside their frames (``_w``, ``_h``), in one shuffle by overlapping bands of rows."""
    reach = sum(len(STEPS[step]) * (h // 2) * n for step, _, h, n in steps)
    room = 2 * max((w // 2) * n for _, w, _, n in steps)
    last = F.floor((F.col("_h") - 1) / tile_height)
    banded = sized.withColumn(
        "_band",
        F.explode(
            F.sequence(
                F.greatest(F.floor((F.col("y") - reach) / tile_height), F.lit(0)),
                F.least(F.floor((F.col("y") + reach) / tile_height), last),
            )
        ),
    )
    types = {f.name: f.dataType.simpleString() for f in sized.schema.fields}

    def clean(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Complete bands, sorted by key and band, a bounded stack at a time."""
        fresh = (pdf[[*keys, "_band"]] != pdf[[*keys, "_band"]].shift()).any(axis=1).to_numpy()
        pdf = pdf.assign(_g=np.cumsum(fresh) - 1)
        heads = pdf[fresh].reset_index(drop=True)
        heads["_top"] = np.maximum(0, heads["_band"] * tile_height - reach)
        heads["_rows"] = np.minimum(heads["_h"], (heads["_band"] + 1) * tile_height + reach) - heads["_top"]
        for (width, rows), same in heads.groupby(["_w", "_rows"]):
            stack = max(1, TILE_CELLS // (width * rows))
            for i in range(0, len(same), stack):
                part = same.iloc[i : i + stack]
                members = pdf[pdf["_g"].isin(part.index)] if len(part) < len(heads) else pdf
                slot = np.searchsorted(part.index.to_numpy(), members["_g"].to_numpy())
                top = part["_top"].to_numpy()
                line = slot * rows + members["y"].to_numpy() - top[slot]
                cells = _fill_words(line, members["x_start"].to_numpy(), members["x_end"].to_numpy(), len(part) * rows, width, room)
                bands = _filter_words(cells.reshape(-1, len(part), rows), steps, width)
                # Runs begin at cells without one before them and end at those without one behind.
                line, start = _set_cells(bands & ~_later(bands, 1))
                end = _set_cells(bands & ~_earlier(bands, 1))[1]
                slot, y = np.divmod(line, rows)
                y = y + top[slot]
                core = y // tile_height == part["_band"].to_numpy()[slot]
                out = part[keys].iloc[slot[core]].reset_index(drop=True)
                out["y"], out["x_start"], out["x_end"] = y[core], start[core], end[core]
                yield out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["y int", "x_start bigint", "x_end bigint"])
    return (
        banded.repartition(*keys, "_band")
        .sortWithinPartitions(*keys, "_band")
        .mapInPandas(lambda batches: whole_groups(batches, [*keys, "_band"], clean), schema)
    )


def run_id(y="y", x="x_start"):
    """Id of a run inside its image; ordered by row, then column."""
    return (F.shiftleft(F.col(y).cast("bigint"), 32) + F.col(x)).alias("run_id")


def _blocks(start, end):
    return F.explode(F.sequence(F.floor(start / BLOCK), F.floor(end / BLOCK)))


def run_adjacency(runs: DataFrame, keys=("image_id",), diagonal: bool = True) -> DataFrame:
    """(keys, src, dst): touching runs of neighbouring rows, each pair once.

    An equi join on (image, row, column block); a pair spanning several blocks
    is kept only in the block where its overlap begins.
    """
    slack = 1 if diagonal else 0
    upper = runs.select(
        *keys, F.col("y").cast("bigint").alias("_y"), F.col("x_start").alias("_as"), F.col("x_end").alias("_ae"),
        run_id().alias("src"),
    ).withColumn("_block", _blocks(F.col("_as"), F.col("_ae")))
    lower = runs.select(
        *keys,
        (F.col("y").cast("bigint") - 1).alias("_y"),
        (F.col("x_start") - slack).alias("_bs"),
        (F.col("x_end") + slack).alias("_be"),
        run_id().alias("dst"),
    ).withColumn("_block", _blocks(F.col("_bs"), F.col("_be")))
    overlap = F.greatest("_as", "_bs")
    return (
        upper.join(lower, [*keys, "_y", "_block"])
        .filter((F.col("_as") <= F.col("_be")) & (F.col("_bs") <= F.col("_ae")))
        .filter(F.floor(overlap / BLOCK) == F.col("_block"))
        .select(*keys, "src", "dst")
    )


def smallest_labels(size: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index over the edges u - v."""
    label = np.arange(size)
    while True:
        lower = label.copy()
        np.minimum.at(lower, u, label[v])
        np.minimum.at(lower, v, label[u])
        # Hooking the old label's root as well keeps long chains short.
        np.minimum.at(lower, label[u], lower[u])
        np.minimum.at(lower, label[v], lower[v])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _band_roots(runs: DataFrame, keys: list[str], slack: int, band_height: int) -> DataFrame:
    """Runs with ``_root``: the smallest run id they reach inside their band of rows."""
    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    group = [*keys, "_band"]

    def label(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fresh = (pdf[group] != pdf[group].shift()).any(axis=1).to_numpy()
        y, start, end = (pdf[c].to_numpy(np.int64) for c in ("y", "x_start", "x_end"))
        # One number line for all rows of all bands, with gaps between them.
        width = int(end.max()) + 4
        line = (np.cumsum(fresh) * (band_height + 1) + y % band_height) * width + 2
        low = np.searchsorted(line + end, line + width + start - slack, "left")
        high = np.searchsorted(line + start, line + width + end + slack, "right")
        count = np.maximum(high - low, 0)
        u = np.repeat(np.arange(len(pdf)), count)
        v = np.arange(len(u)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        root = smallest_labels(len(pdf), u, v)
        out = pdf.drop(columns="_band")
        out["_root"] = (y[root] << 32) + start[root]
        yield out

    columns = [*keys, "y", "x_start", "x_end"]
    schema = ", ".join([f"{c} {types[c]}" for c in columns] + ["_root bigint"])
    return (
        runs.select(*columns, F.floor(F.col("y") / band_height).alias("_band"))
        .repartition(*group)
        .sortWithinPartitions(*group, "y", "x_start")
        .mapInPandas(lambda batches: whole_groups(batches, group, label), schema)
    )


def components(
    runs: DataFrame, keys=("image_id",), diagonal: bool = True, band_height: int = TILE_HEIGHT
) -> DataFrame:
    """Merged runs with ``component``: the smallest run id of the connected region.

    Bands of rows are labelled inside tasks; only the regions that meet at the
    seams between bands go through the distributed component search.
    """
    keys = list(keys)
    rooted = durable(_band_roots(runs, keys, 1 if diagonal else 0, band_height), "band-roots")
    seam = rooted.filter((F.col("y") % band_height == band_height - 1) | (F.col("y") % band_height == 0))
    crossing = run_adjacency(seam, keys, diagonal).filter(
        F.shiftright(F.col("src"), 32) % band_height == band_height - 1
    )
    root_of = lambda name: seam.select(*keys, run_id().alias(name), F.col("_root").alias(f"_{name}"))
    edges = (
        crossing.join(root_of("src"), [*keys, "src"])
        .join(root_of("dst"), [*keys, "dst"])
        .select(*keys, F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    )
    labels = connected_components(edges, keys).withColumnRenamed("node", "_root")
    return (
        rooted.join(labels, [*keys, "_root"], "left")
        .withColumn("component", F.coalesce("component", "_root"))
        .select(*keys, "y", "x_start", "x_end", "component")
    )


def fill_holes(runs: DataFrame, frames: DataFrame, keys=("image_id",)) -> DataFrame:
    """Fill background regions that do not reach the frame.

    Regions lying inside a hole merge into the region around it, so labelling
    the filled mask yields the outermost regions only.
    """
    sound, written, odd = _sized(runs, frames, keys)
    keys, row = list(keys), [*keys, "y"]
    marks = sound.select(*row, "x_start", "x_end", "_w", "_h").distinct()
    ordered = Window.partitionBy(*row).orderBy("x_start")
    # Background beside the runs of a row reaches the frame, as do rows without runs: only gaps between runs can be holes.
    gaps = durable(
        marks.withColumn("_from", F.lag("x_end").over(ordered) + 1).filter(F.col("_from") < F.col("x_start"))
        .select(*row, F.col("_from").cast("bigint").alias("x_start"), (F.col("x_start") - 1).cast("bigint").alias("x_end"), "_h"),
        "mask-gaps",
    )
    region = components(gaps, keys, diagonal=False)
    spans = marks.groupBy(*row).agg(F.min("x_start").alias("_left"), F.max("x_end").alias("_right"))
    beside = gaps.select(*row, "x_start", "x_end", "_h", F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("_y"))
    open_rows = beside.join(spans.withColumnRenamed("y", "_y"), [*keys, "_y"], "left").filter(
        (F.col("_y") < 0) | (F.col("_y") >= F.col("_h")) | F.col("_left").isNull() | (F.col("x_start") < F.col("_left")) | (F.col("x_end") > F.col("_right"))
    )
    outside = region.join(open_rows.select(*row, "x_start").distinct(), [*row, "x_start"], "left_semi").select(*keys, "component").distinct()
    holes = region.join(outside, [*keys, "component"], "left_anti")
    if odd is None:
        return union_masks(runs, holes, keys=keys)
    rest = written.join(odd, keys, "left_semi").select(*row, "x_start", "x_end")
    return union_masks(runs, holes, _holes(rest, frames.join(odd, keys, "left_semi"), keys), keys=keys)


def _holes(runs: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Background regions that do not reach the frame, for runs of any kind."""
    background = components(complement(runs, frames, keys), keys, diagonal=False)
    size = frames.select(*keys, F.col("width").alias("_w"), F.col("height").alias("_h"))
    touches = (
        (F.col("x_start") == 0) | (F.col("x_end") == F.col("_w") - 1) | (F.col("y") == 0) | (F.col("y") == F.col("_h") - 1)
    )
    outside = (
        background.join(size, list(keys)).filter(touches).select(*keys, "component").distinct()
    )
    return background.join(outside, [*keys, "component"], "left_anti")


def component_features(labelled: DataFrame, keys=("image_id",)) -> DataFrame:
    """Area, bounding box, aspect, extent and centre height per component."""
    box = labelled.groupBy(*keys, "component").agg(
        F.sum(F.col("x_end") - F.col("x_start") + 1).cast("bigint").alias("area"),
        F.min("x_start").cast("int").alias("x"),
        F.min("y").cast("int").alias("y"),
        (F.max("x_end") - F.min("x_start") + 1).cast("int").alias("w"),
        (F.max("y") - F.min("y") + 1).cast("int").alias("h"),
    )
    return box.select(
        "*",
        (F.col("w") / F.col("h")).alias("aspect_ratio"),
        (F.col("area") / (F.col("w") * F.col("h"))).alias("extent"),
        (F.col("y") + F.col("h") / 2).alias("centroid_y"),
    )


def contour_areas(labelled: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, component, contour_area): area of the polygon through the centres of a region's outer pixels.

    By the lattice formula it is the pixels, less half the steps around them, less one; it is also what
    2 x 2 windows of the region add up to, one for a full window and a half for one with three pixels. Both kinds
    lie where two runs of neighbouring rows overlap, so no outline is traced. ``labelled`` has the merged runs
    of regions without holes; lines one pixel wide have no area.
    """
    side = lambda start, end: (F.col("x_start").alias(start), F.col("x_end").alias(end))
    upper = labelled.select(*keys, "component", F.col("y").cast("bigint").alias("_y"), *side("_as", "_ae"), _blocks(F.col("x_start"), F.col("x_end")).alias("_block"))
    lower = labelled.select(*keys, "component", (F.col("y").cast("bigint") - 1).alias("_y"), *side("_bs", "_be"), _blocks(F.col("x_start"), F.col("x_end")).alias("_block"))
    first, last = F.greatest("_as", "_bs"), F.least("_ae", "_be")
    half = (F.col("_as") != F.col("_bs")).cast("int") + (F.col("_ae") != F.col("_be")).cast("int")
    met = upper.join(lower, [*keys, "component", "_y", "_block"]).filter((first <= last) & (F.floor(first / BLOCK) == F.col("_block")))
    # A region of one row meets nothing.
    none = labelled.select(*keys, "component", F.lit(0.0).alias("_part"))
    return met.select(*keys, "component", (last - first + half / 2).alias("_part")).unionByName(none).groupBy(*keys, "component").agg(
        F.sum("_part").alias("contour_area")
    )


def contour_features(labelled: DataFrame, keys=("image_id",)) -> DataFrame:
    """:func:`component_features` with the area, and so the extent, of the outline's polygon."""
    return (
        component_features(labelled, keys).join(contour_areas(labelled, keys), [*keys, "component"])
        .withColumn("area", F.col("contour_area"))
        .withColumn("extent", F.col("area") / (F.col("w") * F.col("h")))
        .drop("contour_area")
    )


def leaf_bounding_box(runs: DataFrame, frames: DataFrame, padding: int = 10, keys=("image_id",)) -> DataFrame:
    """(y0, y1, x0, x1) around the mask, padded and clamped; empty masks give the frame.

    The maxima are used as exclusive ends, as a crop of the padded box does.
    """
    box = runs.groupBy(*keys).agg(
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x_start").alias("_x0"), F.max("x_end").alias("_x1")
    )
    low = lambda c: F.coalesce(F.greatest(F.col(c) - padding, F.lit(0)), F.lit(0)).cast("int")
    high = lambda c, limit: F.when(F.col(c).isNull(), F.col(limit)).otherwise(
        F.least(F.col(c) + padding, F.col(limit))
    ).cast("int")
    return frames.join(box, list(keys), "left").select(
        *keys,
        low("_y0").alias("y0"),
        high("_y1", "height").alias("y1"),
        low("_x0").alias("x0"),
        high("_x1", "width").alias("x1"),
    )


def pixels_in_mask(pixels: DataFrame, runs: DataFrame, keys=("image_id",), flag: str = "in_mask") -> DataFrame:
    """Add ``flag``: whether the pixel (y, x) lies in the merged mask.

    Equi join on (image, row, column block) with the run bounds as residual; a
    block of 64 columns holds at most 32 disjoint runs.
    """
    cover = runs.select(
        *keys, "y", F.col("x_start").alias("_s"), F.col("x_end").alias("_e"),
        _blocks(F.col("x_start"), F.col("x_end")).alias("_block"),
    )
    left = pixels.withColumn("_block", F.floor(F.col("x") / BLOCK))
    on = (left["_block"] == cover["_block"]) & (left["y"] == cover["y"]) & left["x"].between(cover["_s"], cover["_e"])
    for k in keys:
        on = on & (left[k] == cover[k])
    hit = left.join(cover, on, "left")
    return hit.select(*[left[c] for c in pixels.columns], cover["_s"].isNotNull().alias(flag))


BOX_CELLS = 1_000_000  # rows of boxes and meetings with marks that are held at a time


def _box_rows(marks: DataFrame, boxes: DataFrame, keys: Sequence[str], name: str, kind: str, measure) -> DataFrame:
    """(keys, box_id, row, ``name``) for all rows of each box, from the marks (keys, y, _s, _e, _v) of its rows.

    Boxes and marks are dealt by bands of rows; the dense rows are made after that shuffle. ``measure`` gets per meeting of
    a box and a mark the box's row, the clipped bounds and the value, then the number of rows and per row how often its box is there.
    """
    keys = list(keys)
    box_type, types = boxes.schema["box_id"].dataType.simpleString(), {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    whole = ["y", "_s", "_e", "x1", "y1", "x2", "y2"]
    band = lambda y: F.floor(y / TILE_HEIGHT)
    no = F.lit(0).cast("bigint")
    met = marks.select(
        *keys, band(F.col("y")).alias("_band"), F.lit(False).alias("_box"), F.lit(0).cast(box_type).alias("box_id"),
        *[F.col(c).cast("bigint").alias(c) for c in whole[:3]], F.col("_v").cast("double").alias("_v"), *[no.alias(c) for c in whole[3:]],
    ).dropna(subset=[*keys, "_band", "_s"])
    dealt = boxes.filter("y1 < y2").select(
        *keys, F.explode(F.sequence(band(F.col("y1")), band(F.col("y2") - 1))).alias("_band"), F.lit(True).alias("_box"), "box_id",
        *[no.alias(c) for c in whole[:3]], F.lit(0.0).alias("_v"), *[F.col(c).cast("bigint").alias(c) for c in whole[3:]],
    )
    group = [*keys, "_band"]

    def rows(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf.assign(_g=np.cumsum((pdf[group] != pdf[group].shift()).any(axis=1).to_numpy()) - 1)
        is_box = pdf["_box"].to_numpy(bool)
        held, mark = pdf[is_box], pdf[~is_box]
        # Equal rows of one box count as often as they are there.
        same = ["_g", "box_id", "x1", "y1", "x2", "y2"]
        often = held.groupby(same, sort=False, dropna=False).size().reset_index(name="_n")
        held = held.drop_duplicates(same).reset_index(drop=True).assign(_n=often["_n"].to_numpy())
        g, low = held["_g"].to_numpy(), np.maximum(held["y1"], held["_band"] * TILE_HEIGHT).to_numpy()
        tall = np.minimum(held["y2"], (held["_band"] + 1) * TILE_HEIGHT).to_numpy() - low
        first, past = (np.searchsorted(mark["_g"].to_numpy(), g, side) for side in ("left", "right"))
        y, start, end, value = (mark[c].to_numpy() for c in ("y", "_s", "_e", "_v"))
        part = np.cumsum(tall + past - first) // BOX_CELLS
        for chosen in np.split(np.arange(len(held)), np.flatnonzero(np.diff(part)) + 1):
            if not len(chosen):
                continue
            n, size = (past - first)[chosen], tall[chosen]
            box = np.repeat(chosen, n)
            at = np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[chosen], n)
            hit = (y[at] >= low[box]) & (y[at] < (low + tall)[box])
            box, at = box[hit], at[hit]
            offset = np.cumsum(size) - size
            line = offset[box - chosen[0]] + y[at] - low[box]
            left, right = (held[c].to_numpy()[box] for c in ("x1", "x2"))
            every = np.repeat(chosen, size)
            number = np.arange(len(every)) - np.repeat(offset, size) + np.repeat((low - held["y1"].to_numpy())[chosen], size)
            out = held[[*keys, "box_id"]].iloc[every].reset_index(drop=True)
            out["row"] = number
            out[name] = measure(line, np.maximum(start[at], left), np.minimum(end[at] + 1, right), value[at], len(every), held["_n"].to_numpy()[every])
            yield out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"box_id {box_type}", "row bigint", f"{name} {kind}"])
    return (
        met.unionByName(dealt).repartition(*group).sortWithinPartitions(*group)
        .mapInPandas(lambda batches: whole_groups(batches, group, rows), schema)
    )


def row_profile(runs: DataFrame, boxes: DataFrame, keys=("image_id",)) -> DataFrame:
    """Mask pixels per row of each box (keys, box_id, row, pixels), empty rows as zero.

    ``boxes`` has (keys, box_id, x1, y1, x2, y2), half-open on the far sides. A run without an end reaches every edge.
    """
    def count(line, left, right, _, size, often):
        return np.bincount(line, np.maximum(right - left, 0), size).astype(np.int64) * often

    ends = F.coalesce(F.col("x_end").cast("bigint"), F.lit(1 << 40))
    marks = runs.select(*keys, "y", F.col("x_start").alias("_s"), ends.alias("_e"), F.lit(0.0).alias("_v"))
    return _box_rows(marks, boxes, keys, "pixels", "bigint", count)


def row_brightness(pixels: DataFrame, boxes: DataFrame, keys=("image_id",)) -> DataFrame:
    """Mean value of masked pixels per box row, zero for rows without any.

    ``pixels`` has (keys, y, x, v, in_mask). Zero-valued pixels do not count.
    """
    def mean(line, left, right, value, size, _):
        line, value = line[left < right], value[left < right]
        pixels = np.bincount(line, minlength=size)
        return np.bincount(line, value, size) / np.maximum(pixels, 1)

    lit = pixels.filter("in_mask and v > 0").groupBy(*keys, "y", "x").agg(F.max("v").alias("_v"))
    marks = lit.select(*keys, "y", F.col("x").alias("_s"), F.col("x").alias("_e"), "_v")
    return _box_rows(marks, boxes, keys, "brightness", "double", mean)
