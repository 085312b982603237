import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoweave.functions import colour
from phenoweave.operators import colourfit
from phenoweave.plans import colour as colour_plan

REFERENCE = np.array(colourfit.REFERENCE_PATCHES, float)

# Published sRGB -> CIE Lab (D65) pairs.
KNOWN = {
    (255, 255, 255): (100.0, 0.0, 0.0),
    (0, 0, 0): (0.0, 0.0, 0.0),
    (255, 0, 0): (53.24, 80.09, 67.20),
    (0, 255, 0): (87.73, -86.18, 83.18),
    (0, 0, 255): (32.30, 79.19, -107.86),
    (128, 128, 128): (53.59, 0.0, 0.0),
}


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(list(KNOWN), "r int, g int, b int")


def test_lab_of_known_colours(known):
    for r in colour.add_lab(known, "r", "g", "b").collect():
        assert (r["L"], r["a"], r["b_"]) == pytest.approx(KNOWN[(r["r"], r["g"], r["b"])], abs=0.06)
    for r in colour.add_lab(known, "r", "g", "b", encoding="opencv8").collect():
        light, a, b = KNOWN[(r["r"], r["g"], r["b"])]
        assert (r["L"], r["a"], r["b_"]) == pytest.approx((light * 2.55, a + 128, b + 128), abs=1)
    with pytest.raises(ValueError):
        colour.add_lab(known, "r", "g", "b", encoding="other")


def test_hsv_of_known_colours(spark):
    rows = {
        (255, 0, 0): (0, 255, 255), (0, 255, 0): (60, 255, 255), (0, 0, 255): (120, 255, 255), (0, 0, 0): (0, 0, 0),
        (90, 90, 90): (0, 0, 90), (100, 200, 50): (50, 191, 200), (255, 0, 1): (0, 255, 255), (10, 20, 10): (60, 128, 20),
    }
    df = spark.createDataFrame(list(rows), "r int, g int, b int")
    h, s, v = colour.hsv(F.col("r"), F.col("g"), F.col("b"))
    for r in df.select("r", "g", "b", h.alias("h"), s.alias("s"), v.alias("v")).collect():
        assert tuple(r)[3:] == rows[tuple(r)[:3]]


def test_lab_clip_switch(spark):
    df = spark.createDataFrame([(200, 128, 128)], "L int, a int, b int")
    kept = colour.add_rgb_from_lab(df, "L", "a", "b", ("r", "g", "b2"), "opencv8", clip_light=False).first()
    cut = colour.add_rgb_from_lab(df, "L", "a", "b", ("r", "g", "b2"), "opencv8", clip_light=True).first()
    assert kept["r"] > 180 and cut["r"] < kept["r"]


def measured(rng):
    mixed = REFERENCE @ np.array([[0.8, 0.1, 0], [0.05, 0.9, 0.02], [0, 0.05, 0.7]]) + (4, -3, 9)
    return np.clip(mixed + rng.normal(0, 4, mixed.shape), 0, 255)


@pytest.fixture(scope="module")
def patches(spark):
    rng = np.random.default_rng(8)
    images = {f"i{k}": measured(rng) for k in range(3)}
    rows = [(name, i, *map(float, rgb)) for name, m in images.items() for i, rgb in enumerate(m) if not (name == "i2" and i in (3, 17))]
    return images, spark.createDataFrame(rows, "image_id string, patch_idx int, r double, g double, b double")


@pytest.mark.parametrize("method", list(colourfit.METHODS))
def test_fit_equals_least_squares(patches, method):
    images, df = patches
    features, scale = colourfit.METHODS[method]
    got = {r["image_id"]: np.array(r["coef"]) for r in colourfit.fit(df, method).collect()}
    for name, m in images.items():
        keep = [i for i in range(24) if not (name == "i2" and i in (3, 17))]
        x = np.prod((m[keep][:, None, :] / 255 * scale) ** np.array(features)[None], axis=2)
        want = np.linalg.lstsq(x, REFERENCE[keep] / 255 * scale, rcond=None)[0].T
        assert x @ got[name].T == pytest.approx(x @ want.T, abs=1e-5 * scale)


def test_correction_lowers_the_squared_error(patches):
    images, df = patches
    fitted = colourfit.fit(df, "linear")
    out = colourfit.with_reference(colourfit.apply_transform(df, fitted, "linear", truncate=False)).toPandas()
    before = colourfit.with_reference(df).toPandas()
    square = lambda p: sum(((p[c] - p[f"ref_{c}"]) ** 2).sum() for c in "rgb")
    assert square(out) < square(before)
    whole = colourfit.apply_transform(df, fitted, "linear").toPandas()
    assert whole[["r", "g", "b"]].isin(range(256)).all().all()


def test_card_windows_and_means(spark):
    frames = spark.createDataFrame([("a", 4080, 3060)], "image_id string, width int, height int")
    windows = {r["patch_idx"]: r for r in colourfit.patch_windows(frames).collect()}
    assert len(windows) == 24
    left, top = 4080 - 516 - 768, 3060 - 291 - 493
    first = windows[0]
    # Straightened window 69..111 x 53..81 of 600 x 400, mapped back to the card.
    assert (first["x0"] - left, first["y0"] - top) == (int(np.ceil(69 * 768 / 599)), int(np.ceil(53 * 493 / 399)))
    assert all(w["y0"] < w["y1"] and w["x0"] < w["x1"] for w in windows.values())
    points = [("a", w["y0"], w["x0"], i, 2 * i, 7) for i, w in windows.items()]
    points += [("a", w["y1"], w["x1"], i + 2, 2 * i, 9) for i, w in windows.items()]
    points += [("a", w["y0"] - 1, w["x0"], 255, 255, 255) for w in windows.values()] + [("a", 0, 0, 1, 1, 1)]
    pixels = spark.createDataFrame(points, "image_id string, y int, x int, r int, g int, b int")
    means = colourfit.patch_means(pixels, frames).collect()
    assert {r["patch_idx"]: (r["r"], r["g"], r["b"]) for r in means} == {i: (i + 1, 2 * i, 8) for i in range(24)}
    compared = colour_plan.compare_methods_on_pixels(pixels, frames, ["linear"]).collect()
    assert {r["method"] for r in compared} == {"original", "linear"}
    corrected = colour_plan.normalise_images(pixels, frames)
    assert corrected.count() == len(points) and corrected.columns == pixels.columns


def test_reference_scores_zero(spark):
    rows = [("a", i, *map(float, rgb)) for i, rgb in enumerate(colourfit.REFERENCE_PATCHES)]
    df = spark.createDataFrame(rows, "image_id string, patch_idx int, r double, g double, b double")
    assert colourfit.mean_delta_e(df).first()["mean_delta_e"] == pytest.approx(0)


def test_unknown_method_is_refused(patches):
    with pytest.raises(ValueError):
        colourfit.fit(patches[1], "spline")


def test_rank_deficient_systems_take_the_smallest_solution():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 24, 4))
    x[1, :, 3] = x[1, :, 0]
    x[2, 3:] = 0
    y = rng.normal(size=(3, 24, 3))
    got = colourfit._least_squares(x, y)
    for k in range(3):
        assert got[k] == pytest.approx(np.linalg.lstsq(x[k], y[k], rcond=None)[0])


def test_patches_stay_distributed(spark, patches):
    """Only the 24 reference rows are sent to every task, whatever Spark estimates of the patches."""
    orders = spark.createDataFrame([(i,) for i in range(40)], "o int").repartition(2)
    rows = orders.select(F.col("o").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("patch_idx"))
    measured = rows.select("*", *[F.lit(float(i)).alias(c) for i, c in enumerate("rgb")])
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan(colourfit.with_reference(measured)) and "BuildLeft" not in plan(colourfit.with_reference(measured))
    fits = colourfit.fit(measured, "linear")
    assert "SortMergeJoin [image_id" in plan(colourfit.apply_transform(measured, fits))


def test_normal_sums_in_long_form(spark):
    rows = [("a", i, *map(float, rgb)) for i, rgb in enumerate(colourfit.REFERENCE_PATCHES)]
    df = spark.createDataFrame(rows, "image_id string, patch_idx int, r double, g double, b double")
    full = np.hstack([REFERENCE, np.ones((24, 1)), REFERENCE])
    got = {(r["i"], r["j"]): r["value"] for r in colourfit.normal_sums(df).collect()}
    assert got == {(i, j): pytest.approx(full[:, i] @ full[:, j]) for i in range(4) for j in range(7)}


def test_patches_of_an_image_meet_in_any_order(spark):
    rng = np.random.default_rng(7)
    rows, cards = [], {}
    for image in (1, 2, 3, None):
        cards[image] = measured(rng)
        rows += [(image, i, *map(float, cards[image][i])) for i in range(24)]
    # A patch measured twice counts by its mean, unknown channels do not, nor do patches off the card.
    rows += [(2, 5, None, 40.0, 60.0), (2, 5, 10.0, 20.0, 30.0), (3, 24, 9.0, 9.0, 9.0), (3, None, 9.0, 9.0, 9.0), (4, 30, 1.0, 2.0, 3.0)]
    cards[2][5] = ((cards[2][5][0] + 10) / 2, (cards[2][5][1] + 60) / 3, (cards[2][5][2] + 90) / 3)
    patches = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "image_id long, patch_idx int, r double, g double, b double").repartition(5)
    found = {r["image_id"]: np.array(r["coef"]) for r in colourfit.fit(patches, "linear").collect()}
    assert found.keys() == cards.keys()
    for image, card in cards.items():
        x = np.column_stack([card / 255, np.ones(24)])
        want = np.linalg.lstsq(x, REFERENCE / 255, rcond=None)[0] * np.array([1, 1, 1, 255])[:, None]
        assert found[image] == pytest.approx(want.T, abs=1e-8)


def test_patches_travel_packed(spark, tables):
    """One row an image is shuffled for a fit, made by many small tasks and not by the few that read the file."""
    from phenoweave.operators.packing import pack

    packed = pack(tables.patches, ["image_id"])
    images = tables.frames.count()
    assert images <= packed.count() < 1.2 * images
    assert packed.rdd.getNumPartitions() >= 100


def odd_patches(spark):
    """Cards with repeated, missing, unknown and partly unknown patches, and patches of no image."""
    rng = np.random.default_rng(21)
    rows = [(image, i, *map(float, rgb)) for image in (*range(300), None) for i, rgb in enumerate(measured(rng)) if not (image == 3 and i in (2, 19))]
    rows += [(5, 7, None, 40.0, 60.0), (5, 7, 10.0, None, 30.0), (5, 7, 12.0, 20.0, 31.0), (6, 24, 9.0, 9.0, 9.0), (6, None, 9.0, 9.0, 9.0)]
    # Off the card alone; the same colour everywhere; a few patches only; every patch twice.
    rows += [(900, 30, 1.0, 2.0, 3.0), *((901, i, 80.0, 80.0, 80.0) for i in range(24)), *((902, i, 9.0 * i, 5.0, 250.0 - i) for i in range(5))]
    rows += [(8, i, *map(float, rgb)) for i, rgb in enumerate(measured(rng))] + [(903, 3, -20.0, 300.0, 70.0)]
    schema = "image_id long, patch_idx int, r double, g double, b double"
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], schema).repartition(3)


@pytest.mark.parametrize("space", ["lab", "rgb"])
def test_cards_score_as_their_patches_do(spark, space):
    patches = odd_patches(spark)
    whole = colourfit.cards(patches)
    rows, found = {"original": patches}, {"original": whole}
    for method in colourfit.METHODS:
        fitted = colourfit.fit(patches, method)
        for cut in (True, False):
            name = f"{method} {cut}"
            rows[name] = colourfit.apply_transform(patches, fitted, method, truncate=cut)
            found[name] = colourfit.apply_transform(whole, colourfit.fit_each(whole, [method])[method], method, truncate=cut)
    scores = lambda df: {(r["method"], r["image_id"]): r["mean_delta_e"] for r in df.collect()}
    got = scores(colourfit.mean_delta_e_each(found, space))
    want = {}
    for name in ("original", "linear True", "polynomial2 False", "polynomial3 True", "cheung2004 False", "vandermonde True"):
        want |= scores(colourfit.mean_delta_e_each({name: rows[name]}, space))
    assert len(got) == 304 + 14 * 303 and ("original", None) in got and ("linear True", None) not in got
    assert {k: got.get(k) for k in want} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert len(want) == 304 + 5 * 303
    assert colourfit.mean_delta_e(whole, space).count() == 304


def test_cards_take_their_own_fits_only(spark, patches):
    one, other = colourfit.cards(patches[1]), colourfit.cards(patches[1])
    fitted = colourfit.fit_each(one, ["linear", "cheung2004"])
    for cards, fits in ((other, fitted["linear"]), (one, fitted["cheung2004"]), (one, colourfit.fit(patches[1], "linear"))):
        with pytest.raises(ValueError):
            colourfit.apply_transform(cards, fits, "linear")
    with pytest.raises(ValueError):
        colourfit.mean_delta_e_each({"a": one, "b": other})


def test_methods_are_compared_in_one_shuffle(spark, patches):
    """The patches were joined with the fits and dealt by image once more for every method."""
    compared = colour_plan.compare_methods(patches[1])
    plan = compared._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Union" not in plan and plan.count("MapInArrow") == 2
    assert {(r["image_id"], r["method"]) for r in compared.collect()} == {(i, m) for i in patches[0] for m in ("original", *colour_plan.COMPARED)}


def test_lab_values_equal_lab_columns(spark):
    rng = np.random.default_rng(2)
    rgb = np.vstack([rng.uniform(0, 255, (40, 3)), rng.integers(0, 256, (40, 3)), [[-5, 0, 300], [0, 0, 0], [255, 255, 255]]])
    df = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(rgb)], "i int, r double, g double, b double")
    rows = colour.add_lab(df, "r", "g", "b", ("x", "y", "z")).orderBy("i").select("x", "y", "z").collect()
    assert colour.lab_values(rgb.T).T == pytest.approx(np.array(rows, float), abs=1e-9)
