"""Pixel colour conversions, card patches, colour fits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoweave.functions import colour, numeric
from phenoweave.operators import colourfit, runs
from phenoweave.plans import colour as colour_plan
from phenoweave.registry.core import register, rounded

_LIN = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END"
_F = lambda c: f"CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787 * {c} + 16.0::DOUBLE / 116 END"


def _lab_ctes(source: str, name: str, r="r", g="g", b="b", prefix="") -> str:
    """CTEs ending in ``name``: the source's columns plus lab_l, lab_a, lab_b (prefixed)."""
    mix = lambda w: " + ".join(f"{c}::DOUBLE * {k}::DOUBLE" for c, k in zip(("lr", "lg", "lb"), w))
    m, white = colour.RGB_TO_XYZ, colour.WHITE
    return f"""{name}_lin AS (SELECT *, {_LIN(r)} AS lr, {_LIN(g)} AS lg, {_LIN(b)} AS lb FROM {source}),
  {name}_xyz AS (SELECT *, ({mix(m[0])}) / {white[0]}::DOUBLE AS xx, ({mix(m[1])}) / {white[1]}::DOUBLE AS yy,
    ({mix(m[2])}) / {white[2]}::DOUBLE AS zz FROM {name}_lin),
  {name}_f AS (SELECT *, {_F("xx")} AS fx, {_F("yy")} AS fy, {_F("zz")} AS fz FROM {name}_xyz),
  {name} AS (SELECT * EXCLUDE (lr, lg, lb, xx, yy, zz, fx, fy, fz), 116 * fy - 16 AS {prefix}lab_l, 500 * (fx - fy) AS {prefix}lab_a,
    200 * (fy - fz) AS {prefix}lab_b FROM {name}_f)"""


_KEY = ["image_id", "y", "x", "r", "g", "b"]

register(
    "pixel_hsv",
    lambda t: t.pixels.select(
        *_KEY, *[c.alias(n) for c, n in zip(colour.hsv(F.col("r"), F.col("g"), F.col("b")), ("h", "s", "v"))]
    ).withColumn("is_green", colour.is_green(F.col("h"), F.col("s"), F.col("v"))),
    """WITH p AS (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS lo FROM pixels),
      d AS (SELECT *, CASE WHEN v = lo THEN 0 WHEN v = r THEN 60.0::DOUBLE * (g - b) / (v - lo) WHEN v = g THEN 120 + 60.0::DOUBLE * (b - r) / (v - lo)
        ELSE 240 + 60.0::DOUBLE * (r - g) / (v - lo) END AS deg FROM p),
      q AS (SELECT *, CAST(floor((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) / 2 + 0.5) AS INTEGER) % 180 AS h,
        CASE WHEN v = 0 THEN 0 ELSE CAST(floor((v - lo) * 255.0::DOUBLE / v + 0.5) AS INTEGER) END AS s FROM d)
      SELECT image_id, y, x, r, g, b, h, s, v, h BETWEEN 35 AND 85 AND s BETWEEN 40 AND 255 AND v BETWEEN 40 AND 255 AS is_green FROM q""",
)
register(
    "pixel_lab",
    lambda t: rounded(colour.add_lab(t.pixels.select(*_KEY), "r", "g", "b", ("lab_l", "lab_a", "lab_b"))),
    f"""WITH {_lab_ctes("pixels", "lab")} SELECT image_id, y, x, r, g, b, round(lab_l, 6) AS lab_l, round(lab_a, 6) AS lab_a,
      round(lab_b, 6) AS lab_b FROM lab""",
)
_CLIP8 = lambda e: f"CAST(least(greatest(floor({e} + 0.5), 0), 255) AS INTEGER)"
_LAB8 = f"""{_lab_ctes("pixels", "lab")}, lab8 AS (SELECT * EXCLUDE (lab_l, lab_a, lab_b), {_CLIP8("lab_l * 2.55")} AS lab_l,
  {_CLIP8("lab_a + 128")} AS lab_a, {_CLIP8("lab_b + 128")} AS lab_b FROM lab)"""


def _lab8(t):
    return colour.add_lab(t.pixels, "r", "g", "b", ("lab_l", "lab_a", "lab_b"), encoding="opencv8")


register(
    "pixel_lab_8bit",
    lambda t: _lab8(t).select(*_KEY, "lab_l", "lab_a", "lab_b"),
    f"WITH {_LAB8} SELECT image_id, y, x, r, g, b, lab_l, lab_a, lab_b FROM lab8",
)
register(
    "lab_to_rgb_round_trip",
    lambda t: colour.add_rgb_from_lab(
        colour.add_lab(t.pixels.select(*_KEY), "r", "g", "b", ("lab_l", "lab_a", "lab_b")), "lab_l", "lab_a", "lab_b", ("r2", "g2", "b2")
    )
    .select("image_id", "r", "g", "b", *[(F.abs(F.col(f"{c}2") - F.col(c)) <= 1).alias(f"{c}_kept") for c in "rgb"]),
    "SELECT image_id, r, g, b, true AS r_kept, true AS g_kept, true AS b_kept FROM pixels",
)
register(
    "masked_channel_statistics",
    lambda t: rounded(colour_plan.channel_statistics(_lab8(t), ("lab_l", "lab_a", "lab_b"))),
    f"""WITH {_LAB8}, m AS (SELECT * FROM lab8 WHERE in_mask) SELECT round(avg(lab_l), 6) AS mean_lab_l, round(stddev_pop(lab_l), 6) AS std_lab_l,
      round(avg(lab_a), 6) AS mean_lab_a, round(stddev_pop(lab_a), 6) AS std_lab_a, round(avg(lab_b), 6) AS mean_lab_b,
      round(stddev_pop(lab_b), 6) AS std_lab_b, count(*) AS pixels FROM m""",
)
register(
    "leaf_channel_statistics",
    lambda t: rounded(
        colour_plan.channel_statistics(
            runs.pixels_in_mask(_lab8(t).drop("in_mask"), t.leaf_runs), ("lab_l", "lab_a", "lab_b")
        )
    ),
    f"""WITH {_LAB8}, m AS (SELECT * FROM lab8 p WHERE EXISTS (SELECT 1 FROM leaf_runs r WHERE r.image_id = p.image_id AND r.y = p.y
        AND p.x BETWEEN r.x_start AND r.x_end))
      SELECT round(avg(lab_l), 6) AS mean_lab_l, round(stddev_pop(lab_l), 6) AS std_lab_l,
      round(avg(lab_a), 6) AS mean_lab_a, round(stddev_pop(lab_a), 6) AS std_lab_a, round(avg(lab_b), 6) AS mean_lab_b,
      round(stddev_pop(lab_b), 6) AS std_lab_b, count(*) AS pixels FROM m""",
)
_STATS = """stats AS (SELECT avg(lab_l) AS ml, stddev_pop(lab_l) AS sl, avg(lab_a) AS ma, stddev_pop(lab_a) AS sa, avg(lab_b) AS mb,
  stddev_pop(lab_b) AS sb FROM lab8 WHERE in_mask)"""
register(
    "normalised_lab_pixels",
    lambda t: rounded(
        colour_plan.normalise_lab(
            _lab8(t), colour_plan.channel_statistics(_lab8(t), ("lab_l", "lab_a", "lab_b")), ("lab_l", "lab_a", "lab_b")
        ).select(*_KEY, "lab_l", "lab_a", "lab_b")
    ),
    f"""WITH {_LAB8}, {_STATS} SELECT image_id, y, x, r, g, b, round(CASE WHEN in_mask THEN (lab_l - ml) / (sl + 1e-8) ELSE 0 END, 6) AS lab_l,
      round(CASE WHEN in_mask THEN (lab_a - ma) / (sa + 1e-8) ELSE 0 END, 6) AS lab_a,
      round(CASE WHEN in_mask THEN (lab_b - mb) / (sb + 1e-8) ELSE 0 END, 6) AS lab_b FROM lab8, stats""",
)
register(
    "normalised_lab_pixels_with_background",
    lambda t: rounded(
        colour_plan.normalise_lab(
            _lab8(t), colour_plan.channel_statistics(_lab8(t), ("lab_l", "lab_a", "lab_b")), ("lab_l", "lab_a", "lab_b"),
            keep_background=True,
        ).select(*_KEY, "lab_l", "lab_a", "lab_b")
    ),
    f"""WITH {_LAB8}, {_STATS} SELECT image_id, y, x, r, g, b, round((lab_l - ml) / (sl + 1e-8), 6) AS lab_l,
      round((lab_a - ma) / (sa + 1e-8), 6) AS lab_a, round((lab_b - mb) / (sb + 1e-8), 6) AS lab_b FROM lab8, stats""",
)
register(
    "fixed_channel_normalisation",
    lambda t: rounded(
        t.pixels.select("image_id", *[colour.normalise_channel(F.col(c), c).alias(c) for c in "rgb"]).select(
            "*", *[(colour.denormalise_channel(F.col(c), c) * 255).alias(f"{c}_back") for c in "rgb"]
        )
    ),
    """SELECT image_id, round((r / 255.0::DOUBLE - 0.485) / 0.229, 6) AS r, round((g / 255.0::DOUBLE - 0.456) / 0.224, 6) AS g,
      round((b / 255.0::DOUBLE - 0.406) / 0.225, 6) AS b, r::DOUBLE AS r_back, g::DOUBLE AS g_back, b::DOUBLE AS b_back FROM pixels""",
)
register(
    "disease_weights",
    lambda t: rounded(
        colour.add_lab(t.pixels, "r", "g", "b", ("lab_l", "lab_a", "lab_b")).select(
            "image_id", "y", "x", colour.disease_weight(F.col("lab_a"), F.col("lab_b"), 2.0, F.col("in_mask")).alias("weight"),
            colour.disease_weight(F.col("lab_a"), F.col("lab_b"), 2.0).alias("weight_all"),
        )
    ),
    f"""WITH {_lab_ctes("pixels", "lab")}, w AS (SELECT *, 1 + least(greatest(lab_a + 30, 0) / 50 + greatest(lab_b - 30, 0) / 50, 1) AS w FROM lab)
      SELECT image_id, y, x, CASE WHEN in_mask THEN round(w, 6) ELSE 0 END AS weight, round(w, 6) AS weight_all FROM w""",
)
register(
    "channel_reorder_and_rotation",
    lambda t: t.pixels.select(
        "image_id",
        colour.rgb_from_bgr(F.struct(F.col("b").alias("c0"), F.col("g").alias("c1"), F.col("r").alias("c2"))).alias("p"),
        *[c.alias(n) for c, n in zip(colour.rotate_clockwise(F.col("y"), F.col("x"), F.lit(50)), ("new_y", "new_x"))],
    ).select("image_id", "p.r", "p.g", "p.b", "new_y", "new_x"),
    "SELECT image_id, r, g, b, x AS new_y, 49 - y AS new_x FROM pixels",
)
register(
    "rescaled_values",
    lambda t: rounded(
        numeric.rescale_unit(t.pixels.select("image_id", "y", "x", "r"), ["image_id"], "r", "scaled")
    ),
    """SELECT image_id, y, x, r, round((r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w + 1e-8), 6) AS scaled FROM pixels
      WINDOW w AS (PARTITION BY image_id)""",
)
register(
    "finite_value_check",
    lambda t: numeric.expect_finite(
        t.recon_metrics.join(t.images.select("image_id"), "image_id", "right"), ["mse", "psnr", "L_mae"]
    ),
    """WITH m AS (SELECT r.* FROM images i LEFT JOIN recon_metrics r USING (image_id))
      SELECT unnest(['mse', 'psnr', 'L_mae']) AS column_name,
        unnest([count(*) FILTER (WHERE mse IS NULL), count(*) FILTER (WHERE psnr IS NULL), count(*) FILTER (WHERE "L_mae" IS NULL)]) AS bad_values FROM m""",
)

# --- colour card ---------------------------------------------------------------

_CARD = {"card_width": 96, "card_height": 40, "from_right": 20, "from_bottom": 4}
_STRAIGHT = {"width": 97, "height": 41}


def _windows_sql() -> str:
    rows = colourfit.grid_spans(_STRAIGHT["height"], 4, _CARD["card_height"])
    cols = colourfit.grid_spans(_STRAIGHT["width"], 6, _CARD["card_width"])
    left, top = 150 - 20 - 96, 50 - 4 - 40
    return ", ".join(
        f"({r * 6 + c}, {top + y0}, {top + y1}, {left + x0}, {left + x1})" for r, (y0, y1) in enumerate(rows) for c, (x0, x1) in enumerate(cols)
    )


_WINDOWS = f"windows AS (SELECT * FROM (VALUES {_windows_sql()}) v(patch_idx, y0, y1, x0, x1))"

register(
    "card_patch_windows",
    lambda t: colourfit.patch_windows(t.frames, _CARD, _STRAIGHT),
    f"WITH {_WINDOWS} SELECT image_id, patch_idx, y0, y1, x0, x1 FROM frames, windows",
)
register(
    "card_patch_means",
    lambda t: rounded(colourfit.patch_means(t.pixels, t.frames, _CARD, _STRAIGHT)),
    f"""WITH {_WINDOWS} SELECT image_id, patch_idx, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b
      FROM pixels JOIN windows ON y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY 1, 2""",
)
register(
    "patches_with_reference",
    lambda t: rounded(colourfit.with_reference(t.patches)),
    """SELECT image_id, patch_idx, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, ref_r, ref_g, ref_b
      FROM patches JOIN reference USING (patch_idx)""",
)
_POLY = "1::DOUBLE, r, g, b, r * r, g * g, b * b, r * g, r * b, g * b"
register(
    "polynomial_features",
    lambda t: rounded(
        t.patches.select(
            "image_id", "patch_idx", F.posexplode(colourfit.polynomial_features(F.col("r"), F.col("g"), F.col("b"), 2)).alias("term", "value")
        )
        .groupBy("image_id", "term")
        .agg(F.sum("value").alias("value"))
    ),
    f"""SELECT image_id, CAST(term AS INTEGER) AS term, round(sum(value), 6) AS value FROM (
      SELECT image_id, unnest(range(10)) AS term, unnest([{_POLY}]) AS value FROM patches) GROUP BY 1, 2""",
)
_X = ("r", "g", "b", "1::DOUBLE")
_SUMS = " UNION ALL ".join(
    f"SELECT image_id, {i} AS i, {j} AS j, sum({_X[i]} * {(_X + ('ref_r', 'ref_g', 'ref_b'))[j]}) AS value FROM matched GROUP BY 1"
    for i in range(4)
    for j in range(7)
)
_NORMAL = f"matched AS (SELECT * FROM patches JOIN reference USING (patch_idx)), sums AS ({_SUMS})"
register(
    "linear_fit_normal_sums",
    lambda t: rounded(colourfit.normal_sums(t.patches), 3),
    f"WITH {_NORMAL} SELECT image_id, i, j, round(value, 3) AS value FROM sums",
)


def _gauss_jordan(size: int, right: int) -> str:
    steps = ["g0 AS (SELECT * FROM sums)"]
    for p in range(size):
        steps.append(
            f"""g{p + 1} AS (SELECT m.image_id, m.i, m.j, CASE WHEN m.i = {p} THEN r.value / d.value
      ELSE m.value - c.value * r.value / d.value END AS value FROM g{p} m
    JOIN g{p} r ON r.image_id = m.image_id AND r.i = {p} AND r.j = m.j JOIN g{p} c ON c.image_id = m.image_id AND c.i = m.i AND c.j = {p}
    JOIN g{p} d ON d.image_id = m.image_id AND d.i = {p} AND d.j = {p})"""
        )
    return ", ".join(steps)


_FITTED = f"{_NORMAL}, {_gauss_jordan(4, 3)}, fitted AS (SELECT image_id, j - 4 AS channel, i AS feature, value AS coef FROM g4 WHERE j >= 4)"
register(
    "linear_colour_fit",
    lambda t: rounded(colourfit.coefficients(colourfit.fit(t.patches, "linear")), 5),
    f"WITH {_FITTED} SELECT image_id, 'linear' AS method, channel, feature, round(coef, 5) AS coef FROM fitted",
)
_WIDE = """wide AS (SELECT image_id, channel, max(coef) FILTER (WHERE feature = 0) AS c0, max(coef) FILTER (WHERE feature = 1) AS c1,
    max(coef) FILTER (WHERE feature = 2) AS c2, max(coef) FILTER (WHERE feature = 3) AS c3 FROM fitted GROUP BY 1, 2)"""
register(
    "linear_colour_correction",
    lambda t: rounded(
        colourfit.apply_transform(t.patches, colourfit.fit(t.patches, "linear"), "linear", truncate=False), 4
    ),
    f"""WITH {_FITTED}, {_WIDE}, out AS (SELECT p.image_id, p.patch_idx, w.channel,
        round(least(greatest(c0 * r + c1 * g + c2 * b + c3, 0), 255), 4) AS v FROM patches p JOIN wide w USING (image_id))
      SELECT image_id, patch_idx, max(v) FILTER (WHERE channel = 0) AS r, max(v) FILTER (WHERE channel = 1) AS g,
        max(v) FILTER (WHERE channel = 2) AS b FROM out GROUP BY 1, 2""",
)


def _fit_sql(method: str) -> str:
    """Normal equations of any feature list on unit-scaled channels, solved by elimination."""
    features, scale = colourfit.METHODS[method]
    p = len(features)
    term = lambda e: " * ".join([c for c, n in zip(("ur", "ug", "ub"), e) for _ in range(n)]) or "1::DOUBLE"
    columns = [*map(term, features), "ref_r / 255", "ref_g / 255", "ref_b / 255"]
    names = ", ".join(f"sum(({columns[i]}) * ({columns[j]}))" for i in range(p) for j in range(p + 3))
    factors = ", ".join(repr(scale ** (1 - sum(e))) + "::DOUBLE" for e in features)
    return f"""WITH unit AS (SELECT *, r / 255 AS ur, g / 255 AS ug, b / 255 AS ub FROM patches JOIN reference USING (patch_idx)),
  packed AS (SELECT image_id, [{names}] AS v FROM unit GROUP BY 1),
  sums AS (SELECT image_id, k // {p + 3} AS i, k % {p + 3} AS j, value FROM (
    SELECT image_id, unnest(range({p * (p + 3)})) AS k, unnest(v) AS value FROM packed)),
  {_gauss_jordan(p, 3)}
  SELECT image_id, '{method}' AS method, CAST(j - {p} AS INTEGER) AS channel, CAST(i AS INTEGER) AS feature,
    round(value * [{factors}][i + 1], 5) AS coef FROM g{p} WHERE j >= {p}"""


for _method in ("polynomial1", "polynomial2", "cheung2004", "finlayson2015", "vandermonde"):
    register(
        f"{_method}_colour_fit",
        lambda t, m=_method: rounded(colourfit.coefficients(colourfit.fit(t.patches, m)), 5),
        _fit_sql(_method),
    )
register(
    "polynomial3_colour_fit", lambda t: rounded(colourfit.coefficients(colourfit.fit(t.patches, "polynomial3")), 6)
)
register(
    "corrected_pixels",
    lambda t: colourfit.apply_transform(t.pixels, colourfit.fit(t.patches, "linear"), "linear"),
    f"""WITH {_FITTED}, {_WIDE}, flat AS (SELECT image_id, list([c0, c1, c2, c3] ORDER BY channel) AS m FROM wide GROUP BY 1)
      SELECT image_id, y, x, {", ".join(
          f"CAST(floor(least(greatest(m[{k}][1] * r + m[{k}][2] * g + m[{k}][3] * b + m[{k}][4], 0), 255)) AS INTEGER) AS {c}"
          for k, c in ((1, "r"), (2, "g"), (3, "b")))}, in_mask FROM pixels JOIN flat USING (image_id)""",
)
_PATCH_LAB = (
    "matched AS (SELECT * FROM patches JOIN reference USING (patch_idx)), "
    + _lab_ctes("matched", "measured")
    + ", "
    + _lab_ctes("measured", "scored", "ref_r", "ref_g", "ref_b", "ref_")
    + """, errors AS (SELECT image_id, patch_idx, sqrt((lab_l - ref_lab_l) ** 2 + (lab_a - ref_lab_a) ** 2 + (lab_b - ref_lab_b) ** 2) AS delta_e FROM scored)"""
)
register(
    "patch_delta_e",
    lambda t: rounded(colourfit.patch_delta_e(t.patches).select("image_id", "patch_idx", "delta_e")),
    f"WITH {_PATCH_LAB} SELECT image_id, patch_idx, round(delta_e, 6) AS delta_e FROM errors",
)
register(
    "mean_delta_e",
    lambda t: rounded(colourfit.mean_delta_e(t.patches)),
    f"WITH {_PATCH_LAB} SELECT image_id, round(avg(delta_e), 6) AS mean_delta_e FROM errors GROUP BY 1",
)
register(
    "mean_delta_e_rgb",
    lambda t: rounded(colourfit.mean_delta_e(t.patches, space="rgb")),
    """SELECT image_id, round(avg(sqrt((r - ref_r) ** 2 + (g - ref_g) ** 2 + (b - ref_b) ** 2)), 6) AS mean_delta_e
      FROM patches JOIN reference USING (patch_idx) GROUP BY 1""",
)
register("colour_method_comparison", lambda t: rounded(colour_plan.compare_methods(t.patches), 4))
