import numpy as np
import pytest
import rasters
from pyspark.sql import functions as F

from phenoweave.operators import runs, strips

SHAPES = rasters.shapes()


@pytest.fixture(scope="module")
def masks(spark):
    rows = [r for name, m in SHAPES.items() for r in rasters.to_runs(m, name)]
    return spark.createDataFrame(rows, "image_id string, y int, x_start bigint, x_end bigint")


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(n, 64, 40) for n in SHAPES], "image_id string, width int, height int")


def compare(df, expected):
    found = {}
    for r in df.collect():
        found.setdefault(r["image_id"], []).append(r)
    for name, mask in SHAPES.items():
        got = rasters.from_runs(found.get(name, []), mask.shape)
        want = expected(mask)
        assert (got == want).all(), name
        # Runs are merged: as many as the mask has stretches.
        assert len(found.get(name, [])) == len(rasters.to_runs(want, name)), name


def test_complement(masks, frames):
    compare(runs.complement(masks, frames), lambda m: ~m)


@pytest.mark.parametrize("width,height,iterations", [(7, 5, 1), (1, 9, 1), (5, 3, 2)])
def test_dilate_and_erode(masks, frames, width, height, iterations):
    def repeat(step):
        def run(m):
            for _ in range(iterations):
                m = step(m, width, height)
            return m

        return run

    compare(runs.dilate(masks, frames, width, height, iterations), repeat(rasters.dilate))
    compare(runs.erode(masks, frames, width, height, iterations), repeat(rasters.erode))


def test_open_and_close(masks, frames):
    compare(runs.close(masks, frames, 7, 5), lambda m: rasters.erode(rasters.dilate(m, 7, 5), 7, 5))
    compare(runs.open_(masks, frames, 5, 5), lambda m: rasters.dilate(rasters.erode(m, 5, 5), 5, 5))


@pytest.mark.parametrize("tile_height", [5, 17, 256])
def test_clean_green_mask(masks, frames, tile_height):
    compare(runs.clean_green_mask(masks, frames, tile_height=tile_height), rasters.clean)


def test_cleaning_equals_the_chained_operators(masks, frames):
    closed = runs.close(runs.merge_runs(masks), frames, 15, 15, 2)
    chained = runs.open_(runs.close(closed, frames, 25, 5), frames, 5, 5)
    want = sorted(map(tuple, chained.collect()))
    assert sorted(map(tuple, runs.clean_green_mask(masks, frames).collect())) == want


def test_fill_holes(masks, frames):
    compare(runs.fill_holes(masks, frames), rasters.fill)


@pytest.mark.parametrize("diagonal,band_height", [(True, 256), (False, 256), (True, 7), (False, 7), (True, 1)])
def test_components(masks, diagonal, band_height):
    labelled = runs.components(masks, diagonal=diagonal, band_height=band_height).collect()
    for name, mask in SHAPES.items():
        want = rasters.label(mask, diagonal)
        pairs = {(r["component"], want[r["y"], r["x_start"]]) for r in labelled if r["image_id"] == name}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == want.max(), name


def test_adjacency_over_many_blocks(spark):
    wide = np.zeros((3, 600), bool)
    wide[0, :] = True
    wide[1, 10:590] = True
    wide[2, 0:600:3] = True
    df = spark.createDataFrame(rasters.to_runs(wide, "w"), "image_id string, y int, x_start bigint, x_end bigint")
    edges = runs.run_adjacency(df).collect()
    assert len(edges) == len(set(edges)) == 1 + sum(9 <= x <= 590 for x in range(0, 600, 3))


def test_component_features(masks):
    found = {r["image_id"]: r for r in runs.component_features(runs.components(masks.filter("image_id = 'bar'"))).collect()}
    bar = found["bar"]
    assert (bar["x"], bar["y"], bar["w"], bar["h"], bar["area"]) == (5, 10, 55, 10, 550)
    assert bar["aspect_ratio"] == 5.5 and bar["extent"] == 1.0 and bar["centroid_y"] == 15.0


def test_strip_heights_count_holes_in_the_extent(spark, masks):
    tagged = masks.withColumn("strip_id", F.lit(0))
    every = spark.createDataFrame([(n, 0) for n in SHAPES], "image_id string, strip_id int")
    for r in strips.measure_strips(tagged, every).collect():
        mask = SHAPES[r["image_id"]]
        columns = [np.flatnonzero(c) for c in mask.T if c.any()]
        heights = np.array([c.max() - c.min() + 1 for c in columns]) if columns else np.zeros(1)
        want = (heights.mean(), np.median(heights), heights.min(), heights.max(), np.ptp(heights), mask.sum())
        got = [r[c] for c in strips.PHENOTYPES]
        assert got == pytest.approx(want), r["image_id"]


def test_bounding_box_and_pixels(spark, masks, frames):
    boxes = {r["image_id"]: r for r in runs.leaf_bounding_box(masks, frames).collect()}
    assert tuple(boxes["bar"])[1:] == (0, 29, 0, 64)
    assert tuple(boxes["empty"])[1:] == (0, 40, 0, 64)
    points = [(n, y, x) for n in SHAPES for y in range(0, 40, 3) for x in range(64)]
    df = spark.createDataFrame(points, "image_id string, y int, x int")
    rows = runs.pixels_in_mask(df, masks).collect()
    assert len(rows) == len(points)
    assert all(r["in_mask"] == SHAPES[r["image_id"]][r["y"], r["x"]] for r in rows)


def test_union_of_overlapping_runs(spark):
    rows = [("a", 0, 0, 4), ("a", 0, 2, 3), ("a", 0, 5, 9), ("a", 0, 11, 12), ("a", 0, 0, 1)]
    df = spark.createDataFrame(rows, "image_id string, y int, x_start bigint, x_end bigint")
    got = sorted((r["x_start"], r["x_end"]) for r in runs.union_masks(df, df).collect())
    assert got == [(0, 9), (11, 12)]


def test_contour_areas_equal_polygons(spark):
    """Known polygons through pixel centres, and many random regions."""
    known = {
        "dot": ([(2, 2)], 0.0), "line": ([(3, x) for x in range(9)], 0.0), "step": ([(1, 1), (2, 2), (3, 3)], 0.0),
        "square": ([(y, x) for y in range(2, 7) for x in range(1, 6)], 16.0), "diamond": ([(2, 1), (1, 2), (2, 3), (3, 2), (2, 2)], 2.0),
        "triangle": ([(y, x) for y in range(6) for x in range(y + 1)], 12.5), "l": ([(y, 0) for y in range(6)] + [(5, x) for x in range(7)], 0.5),
        "wide": ([(y, x) for y in range(3) for x in range(200)], 398.0),
    }
    shapes = {name: np.zeros((12, 210), bool) for name in known}
    for name, (pixels, _) in known.items():
        for y, x in pixels:
            shapes[name][y, x] = True
    rng = np.random.default_rng(12)
    for k in range(1000):
        # Overlapping boxes around one point: one region, holes filled by construction of rows without gaps.
        m = np.zeros((14, 150), bool)
        for _ in range(rng.integers(1, 6)):
            a, b = sorted(rng.integers(0, 14, 2))
            c, d = sorted(rng.integers(0, 150, 2))
            m[min(a, 7) : max(b, 7) + 1, min(c, 70) : max(d, 70) + 1] = True
        shapes[f"r{k}"] = m
    rows = [(*r, 0) for name, m in shapes.items() for r in rasters.to_runs(m, name)]
    labelled = spark.createDataFrame(rows, "image_id string, y int, x_start bigint, x_end bigint, component bigint")
    got = {r.image_id: r.contour_area for r in runs.contour_areas(labelled).collect()}
    assert got == {name: rasters.outline_area(m) for name, m in shapes.items() if m.any()}
    assert all(got[name] == area for name, (_, area) in known.items())


def test_merging_shuffles_once_and_steps_make_no_row_copies(spark):
    """A dilation or closing deals runs by bands; no run becomes one row per raster row it reaches."""
    masks = spark.createDataFrame([(1, 3, 2, 5), (1, 3, 6, 7), (2, 0, 0, 9)], "image_id long, y int, x_start long, x_end long")
    frames = spark.createDataFrame([(1, 10, 8), (2, 10, 8)], "image_id long, width int, height int")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert str(runs.merge_runs(masks)._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    assert "PythonMapInArrow" in plan(runs.dilate(masks, frames, 3, 3)) or "MapInPandas" in plan(runs.dilate(masks, frames, 3, 3))
    assert sorted(map(tuple, runs.dilate(masks, frames, 3, 3).collect())) == [(1, y, 1, 8) for y in (2, 3, 4)] + [(2, y, 0, 9) for y in (0, 1)]


def test_steps_keep_images_with_runs_beyond_the_frame(spark):
    masks = spark.createDataFrame([(1, 3, 2, 14), (2, 0, None, 4), (3, 2, 1, 3)], "image_id long, y int, x_start long, x_end long")
    frames = spark.createDataFrame([(i, 10, 5) for i in (1, 2, 3)], "image_id long, width int, height int")
    got = sorted(map(tuple, runs.dilate(masks, frames, 3, 3).collect()))
    assert got == [(1, y, 1, 9) for y in (2, 3, 4)] + [(2, y, 0, 5) for y in (0, 1)] + [(3, y, 0, 4) for y in (1, 2, 3)]


def test_heights_of_whole_masks(spark):
    rows = [("a", 0, 2, 0, 3), ("a", 0, 5, 2, 4), ("b", 1, 7, 9, 9), ("c", 0, None, 1, 2)]
    frame = spark.createDataFrame(rows, "image_id string, strip_id int, y int, x_start long, x_end long")
    got = sorted((r["image_id"], r["height"] or 0, r["columns"], r["pixels"]) for r in strips.height_counts(frame).collect())
    assert got == [("a", 1, 3, 3), ("a", 4, 2, 4), ("b", 1, 1, 1), ("c", 0, 2, 2)]


@pytest.mark.parametrize("width", [1, 63, 64, 65, 130, 192])
def test_steps_on_words_equal_steps_on_cells(width):
    """Sixty-four columns to a word, across the borders of words and up to the frame."""
    rng = np.random.default_rng(width)
    bands = rng.random((3, 12, width)) < 0.7
    dense = {"close": lambda m, w, h: rasters.erode(rasters.dilate(m, w, h), w, h), "open": lambda m, w, h: rasters.dilate(rasters.erode(m, w, h), w, h),
             "dilate": rasters.dilate, "erode": rasters.erode}
    for step, w, h in (("erode", 3, 1), ("dilate", 5, 3), ("close", 131, 3), ("open", 3, 3), ("open", 1, 5)):
        line, column = np.nonzero(bands.reshape(-1, width))
        words = runs._fill_words(line, column, column, 36, width, w).reshape(-1, 3, 12)
        got = np.zeros((36, width), bool)
        got[runs._set_cells(runs._filter_words(words, ((step, w, h, 1),), width))] = True
        assert (got.reshape(bands.shape) == np.array([dense[step](m, w, h) for m in bands])).all(), step
