"""Run-length masks: measurement, union, morphology, components, pixel tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoweave.operators import runs, strips
from phenoweave.registry.core import register, rounded

_COLUMNS = """columns AS (
  SELECT image_id, strip_id, x, max(y) - min(y) + 1 AS height, count(*) AS pixels
  FROM (SELECT image_id, strip_id, y, unnest(generate_series(x_start, x_end)) AS x FROM strip_runs) GROUP BY 1, 2, 3)"""

register(
    "strip_heights",
    lambda t: rounded(
        strips.measure_masks(
            t.raw_runs, t.frames.select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("strip_id"))
        )
    ),
    f"""WITH {_COLUMNS}, m AS (SELECT image_id, strip_id, avg(height) AS mean_h, median(height) AS med_h, min(height) AS min_h,
        max(height) AS max_h, sum(pixels) AS px FROM columns GROUP BY 1, 2)
      SELECT image_id, s.strip_id, round(coalesce(mean_h, 0), 6)::DOUBLE AS mean_height_px, coalesce(med_h, 0)::DOUBLE AS median_height_px,
        coalesce(min_h, 0)::DOUBLE AS min_height_px, coalesce(max_h, 0)::DOUBLE AS max_height_px,
        coalesce(max_h - min_h, 0)::DOUBLE AS height_range_px, CAST(coalesce(px, 0) AS BIGINT) AS area_px
      FROM (SELECT image_id, unnest([0, 1]) AS strip_id FROM frames) s LEFT JOIN m USING (image_id, strip_id)""",
)
register(
    "strip_mask_union",
    lambda t: runs.union_masks(t.strip_runs.filter("strip_id = 0"), t.strip_runs.filter("strip_id = 1")),
    """WITH p AS (SELECT DISTINCT image_id, y, x FROM (SELECT image_id, y, unnest(generate_series(x_start, x_end)) AS x FROM raw_runs)),
      g AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM p)
      SELECT image_id, y, min(x) AS x_start, max(x) AS x_end FROM g GROUP BY image_id, y, island""",
)
register(
    "merged_strip_runs",
    lambda t: t.strip_runs,
    """WITH p AS (SELECT DISTINCT image_id, strip_id, y, x FROM (
        SELECT image_id, strip_id, y, unnest(generate_series(x_start, x_end)) AS x FROM raw_runs)),
      g AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, strip_id, y ORDER BY x) AS island FROM p)
      SELECT image_id, strip_id, y, min(x) AS x_start, max(x) AS x_end FROM g GROUP BY image_id, strip_id, y, island""",
)
register(
    "mask_complement",
    lambda t: runs.complement(t.leaf_runs, t.frames)
    .groupBy("image_id")
    .agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("x_end") - F.col("x_start") + 1).alias("pixels"), F.sum("x_start").alias("starts")),
    """WITH rows AS (SELECT image_id, width, unnest(generate_series(0, height - 1)) AS y FROM frames),
      e AS (SELECT image_id, y, x_start AS s, x_end AS e FROM leaf_runs UNION ALL SELECT image_id, y, width, width FROM rows),
      gaps AS (SELECT image_id, coalesce(lag(e) OVER (PARTITION BY image_id, y ORDER BY s) + 1, 0) AS a, s - 1 AS b FROM e)
      SELECT image_id, count(*) AS runs, CAST(sum(b - a + 1) AS BIGINT) AS pixels, CAST(sum(a) AS BIGINT) AS starts
      FROM gaps WHERE a <= b GROUP BY 1""",
)
# Dilation on pixels: every pixel's horizontal reach, then every row's.
_DILATED = """SELECT image_id, y, min(x) AS x_start, max(x) AS x_end FROM (
      SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM (
        SELECT DISTINCT image_id, y, x FROM (
          SELECT image_id, y + dy AS y, x FROM (
            SELECT DISTINCT image_id, y, unnest(generate_series(greatest(x_start - {rx}, 0), least(x_end + {rx}, 149))) AS x FROM raw_runs) a,
            (SELECT unnest(generate_series(-{ry}, {ry})) AS dy) d
          WHERE y + dy BETWEEN 0 AND 49))) GROUP BY image_id, y, island"""
register(
    "mask_dilation",
    lambda t: runs.dilate(t.leaf_runs, t.frames, 25, 5),
    _DILATED.format(rx=12, ry=2),
)
# Opening on pixels: a pixel survives erosion when its whole window inside the frame is set.
register(
    "mask_opening",
    lambda t: runs.open_(t.leaf_runs, t.frames, 5, 1),
    """WITH p AS (SELECT DISTINCT image_id, y, x FROM (SELECT image_id, y, unnest(generate_series(x_start, x_end)) AS x FROM raw_runs)),
      kept AS (SELECT image_id, y, x FROM (SELECT image_id, y, x, count(*) OVER (PARTITION BY image_id, y ORDER BY x
          RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM p) WHERE n = least(x + 2, 149) - greatest(x - 2, 0) + 1),
      grown AS (SELECT DISTINCT image_id, y, x + dx AS x FROM kept, (SELECT unnest(generate_series(-2, 2)) AS dx) WHERE x + dx BETWEEN 0 AND 149)
      SELECT image_id, y, min(x) AS x_start, max(x) AS x_end FROM (
        SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM grown) GROUP BY image_id, y, island""",
)


def _grown(source: str, width: int, height: int, iterations: int) -> str:
    """Runs of a dilation: every run reaches into the rows around it, and what touches is one run."""
    rx, ry = (width // 2) * iterations, (height // 2) * iterations
    return f"""SELECT image_id, y, min(s) AS x_start, max(e) AS x_end FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY image_id, y ORDER BY s, e) AS island FROM (
        SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY image_id, y ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh
        FROM (SELECT DISTINCT image_id, y + dy AS y, greatest(x_start - {rx}, 0) AS s, least(x_end + {rx}, 149) AS e
          FROM {source}, (SELECT unnest(generate_series(-{ry}, {ry})) AS dy) WHERE y + dy BETWEEN 0 AND 49))) GROUP BY image_id, y, island"""


def _outside(source: str) -> str:
    """Runs of the background."""
    return f"""SELECT image_id, y, a AS x_start, b AS x_end FROM (
      SELECT image_id, y, coalesce(lag(e) OVER (PARTITION BY image_id, y ORDER BY s) + 1, 0) AS a, s - 1 AS b FROM (
        SELECT image_id, y, x_start AS s, x_end AS e FROM {source}
        UNION ALL SELECT image_id, unnest(generate_series(0, height - 1)), width, width FROM frames)) WHERE a <= b"""


def _steps(steps) -> str:
    """A chain of (closing, opening, dilation or erosion, width, height, iterations) over the leaf runs."""
    chain, last = [], "leaf_runs"
    for step, w, h, n in steps:
        for grow in {"close": (True, False), "open": (False, True), "dilate": (True,), "erode": (False,)}[step]:
            for sql in (lambda x: _grown(x, w, h, n),) if grow else (_outside, lambda x: _grown(x, w, h, n), _outside):
                chain.append(f"m{len(chain)} AS MATERIALIZED ({sql(last)})")
                last = f"m{len(chain) - 1}"
    return f"WITH {', '.join(chain)} SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x_start AS BIGINT) AS x_start, CAST(x_end AS BIGINT) AS x_end FROM {last}"


def _typed(df):
    return df.select("image_id", F.col("y").cast("int").alias("y"), F.col("x_start").cast("bigint").alias("x_start"), F.col("x_end").cast("bigint").alias("x_end"))


register("mask_erosion", lambda t: _typed(runs.erode(t.leaf_runs, t.frames, 5, 5)), _steps([("erode", 5, 5, 1)]))
register("mask_closing_twice", lambda t: _typed(runs.close(t.leaf_runs, t.frames, 15, 15, 2)), _steps([("close", 15, 15, 2)]))
register("mask_closing_wide", lambda t: _typed(runs.close(t.leaf_runs, t.frames, 25, 5)), _steps([("close", 25, 5, 1)]))
register("mask_opening_square", lambda t: _typed(runs.open_(t.leaf_runs, t.frames, 5, 5)), _steps([("open", 5, 5, 1)]))
# The whole chain in one shuffle of bands, against one step after another.
register("clean_green_mask", lambda t: _typed(runs.clean_green_mask(t.raw_runs, t.frames)), _steps(runs.CLEANING))

_EDGES = """adjacent AS (SELECT a.image_id, (a.y::BIGINT << 32) + a.x_start AS src, (b.y::BIGINT << 32) + b.x_start AS dst
    FROM leaf_runs a JOIN leaf_runs b ON a.image_id = b.image_id AND b.y = a.y + 1
      AND a.x_start <= b.x_end + 1 AND b.x_start <= a.x_end + 1)"""
_LABELLED = f"""{_EDGES},
  linked AS (SELECT image_id, src AS u, dst AS v FROM adjacent UNION ALL SELECT image_id, dst, src FROM adjacent),
  reach AS (SELECT image_id, (y::BIGINT << 32) + x_start AS node, (y::BIGINT << 32) + x_start AS seen FROM leaf_runs
    UNION SELECT r.image_id, r.node, l.v FROM reach r JOIN linked l ON l.image_id = r.image_id AND l.u = r.seen),
  labelled AS (SELECT l.*, c.component FROM leaf_runs l JOIN (
    SELECT image_id, node, min(seen) AS component FROM reach GROUP BY 1, 2) c
    ON c.image_id = l.image_id AND c.node = (l.y::BIGINT << 32) + l.x_start)"""

register(
    "run_adjacency",
    lambda t: runs.run_adjacency(t.leaf_runs),
    f"WITH {_EDGES} SELECT image_id, src, dst FROM adjacent",
)
register(
    "mask_components",
    lambda t: runs.components(t.leaf_runs),
    f"WITH RECURSIVE {_LABELLED} SELECT image_id, y, x_start, x_end, component FROM labelled",
)
register(
    "component_features",
    lambda t: rounded(runs.component_features(runs.components(t.leaf_runs))),
    f"""WITH RECURSIVE {_LABELLED}, f AS (SELECT image_id, component, CAST(sum(x_end - x_start + 1) AS BIGINT) AS area,
        CAST(min(x_start) AS INTEGER) AS x, min(y) AS y, CAST(max(x_end) - min(x_start) + 1 AS INTEGER) AS w, max(y) - min(y) + 1 AS h
        FROM labelled GROUP BY 1, 2)
      SELECT *, round(w / h, 6) AS aspect_ratio, round(area / (w * h), 6) AS extent, round(y + h / 2, 6) AS centroid_y FROM f""",
)
register(
    "contour_areas",
    lambda t: runs.contour_areas(runs.components(t.leaf_runs)),
    # Windows of two by two pixels: a full one counts one, three pixels of one region a half.
    f"""WITH RECURSIVE {_LABELLED}, p AS (SELECT image_id, component, y, unnest(generate_series(x_start, x_end)) AS x FROM labelled),
      w AS (SELECT image_id, component, y + dy AS wy, x + dx AS wx, count(*) AS n FROM p, (VALUES (0, 0), (0, -1), (-1, 0), (-1, -1)) d(dy, dx) GROUP BY ALL)
      SELECT image_id, component, CAST(sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END) AS DOUBLE) AS contour_area FROM w GROUP BY 1, 2""",
)
register("filled_masks", lambda t: runs.fill_holes(t.leaf_runs, t.frames))
register(
    "leaf_bounding_boxes",
    lambda t: runs.leaf_bounding_box(t.leaf_runs, t.frames),
    """SELECT image_id, CAST(coalesce(greatest(min(y) - 10, 0), 0) AS INTEGER) AS y0, CAST(coalesce(least(max(y) + 10, 50), 50) AS INTEGER) AS y1,
      CAST(coalesce(greatest(min(x_start) - 10, 0), 0) AS INTEGER) AS x0, CAST(coalesce(least(max(x_end) + 10, 150), 150) AS INTEGER) AS x1
      FROM (SELECT f.image_id, r.y, r.x_start, r.x_end FROM frames f LEFT JOIN leaf_runs r USING (image_id)) GROUP BY image_id""",
)
register(
    "pixels_in_mask",
    lambda t: runs.pixels_in_mask(t.pixels.drop("in_mask"), t.leaf_runs),
    """SELECT p.image_id, p.y, p.x, p.r, p.g, p.b, r.x_start IS NOT NULL AS in_mask FROM pixels p LEFT JOIN leaf_runs r
      ON r.image_id = p.image_id AND r.y = p.y AND p.x BETWEEN r.x_start AND r.x_end""",
)
