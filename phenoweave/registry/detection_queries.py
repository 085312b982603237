"""Candidate boxes, their choice and splitting, and row profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoweave.operators import detection, runs, strips
from phenoweave.registry.core import register, rounded

_MIN_AREA = 20000

_CANDIDATES = f"""candidates AS (
  SELECT *, x AS x1, y AS y1, x + w AS x2, y + h AS y2, area::DOUBLE * CASE WHEN aspect_ratio > 2 THEN 1.5::DOUBLE ELSE 1 END
    * CASE WHEN extent > 0.5 THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN area > 50000 THEN 1.2::DOUBLE ELSE 1 END AS score
  FROM features WHERE area > {_MIN_AREA})"""
_FIRST = f"""{_CANDIDATES},
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y1, x1, y2, x2) AS rank FROM candidates)
    WHERE rank = 1)"""
_CHOSEN = f"""{_FIRST},
  seconds AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.image_id ORDER BY c.score DESC, c.y1, c.x1, c.y2, c.x2) AS n
      FROM candidates c JOIN firsts f ON f.image_id = c.image_id AND abs(c.centroid_y - f.centroid_y) >= 0.1::DOUBLE * c.image_height) WHERE n = 1),
  chosen AS (SELECT image_id, x1, y1, x2, y2, score, 1 AS rank FROM firsts
    UNION ALL SELECT image_id, x1, y1, x2, y2, score, 2 FROM seconds)"""


def _candidates(t):
    return detection.candidates(t.features, _MIN_AREA)


register(
    "candidate_scores",
    lambda t: rounded(_candidates(t).select("image_id", "x1", "y1", "x2", "y2", "area", "score"), 4),
    f"WITH {_CANDIDATES} SELECT image_id, x1, y1, x2, y2, area, round(score, 4) AS score FROM candidates",
)
register(
    "separated_boxes",
    lambda t: rounded(
        detection.separated(_candidates(t)).select("image_id", "x1", "y1", "x2", "y2", "score", "rank"), 4
    ),
    f"WITH {_CHOSEN} SELECT image_id, x1, y1, x2, y2, round(score, 4) AS score, rank FROM chosen",
)
register(
    "separated_three_boxes",
    lambda t: rounded(
        detection.separated(_candidates(t), k=3).select("image_id", "x1", "y1", "score", "rank"), 4
    ),
    f"""WITH {_CHOSEN}, thirds AS (SELECT * FROM (
        SELECT c.*, row_number() OVER (PARTITION BY c.image_id ORDER BY c.score DESC, c.y1, c.x1, c.y2, c.x2) AS n
        FROM candidates c JOIN firsts f ON f.image_id = c.image_id AND abs(c.centroid_y - f.centroid_y) >= 0.1::DOUBLE * c.image_height
        JOIN seconds s ON s.image_id = c.image_id AND abs(c.centroid_y - s.centroid_y) >= 0.1::DOUBLE * c.image_height) WHERE n = 1)
      SELECT image_id, x1, y1, round(score, 4) AS score, rank FROM chosen UNION ALL SELECT image_id, x1, y1, round(score, 4), 3 FROM thirds""",
)
register(
    "top_two_boxes",
    lambda t: rounded(
        detection.top_boxes(_candidates(t)).select("image_id", "x1", "y1", "x2", "y2", "score", "rank"), 4
    ),
    f"""WITH {_CANDIDATES} SELECT image_id, x1, y1, x2, y2, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y1, x1, y2, x2) AS rank FROM candidates) WHERE rank <= 2""",
)
register(
    "numbered_boxes",
    lambda t: strips.number_boxes(
        detection.separated(_candidates(t)).select("image_id", "x1", "y1", "x2", "y2")
    ),
    f"""WITH {_CHOSEN} SELECT image_id, x1, y1, x2, y2,
      row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, y2, x2) - 1 AS strip_id FROM chosen""",
)
_PAIRS = """top2 AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y1, x1, y2, x2) AS rank FROM candidates),
  pairs AS (SELECT a.image_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
    FROM top2 a JOIN top2 b ON b.image_id = a.image_id AND a.rank = 1 AND b.rank = 2),
  nested AS (SELECT image_id, ax1 AS x1, ay1 AS y1, ax2 AS x2, ay2 AS y2 FROM pairs WHERE bx1 >= ax1 AND bx2 <= ax2 AND by1 >= ay1 AND by2 <= ay2
    UNION ALL SELECT image_id, bx1, by1, bx2, by2 FROM pairs WHERE ax1 >= bx1 AND ax2 <= bx2 AND ay1 >= by1 AND ay2 <= by2
      AND NOT (bx1 >= ax1 AND bx2 <= ax2 AND by1 >= ay1 AND by2 <= ay2))"""


def _nested(t):
    top = detection.top_boxes(_candidates(t))
    return detection.nested_outer(detection.pair_boxes(top)).select("image_id", "outer.*")


register("nested_boxes", _nested, f"WITH {_CANDIDATES}, {_PAIRS} SELECT image_id, x1, y1, x2, y2 FROM nested")
register(
    "nested_boxes_split",
    lambda t: detection.split_at(_nested(t), detection.midpoint(F.col("y1"), F.col("y2"))),
    f"""WITH {_CANDIDATES}, {_PAIRS} SELECT image_id, 0 AS strip_id, x1, y1, x2, (y1 + y2) // 2 AS y2 FROM nested
      UNION ALL SELECT image_id, 1, x1, (y1 + y2) // 2, x2, y2 FROM nested""",
)
register(
    "boxes_split_with_margin",
    lambda t: detection.split_at(
        detection.separated(_candidates(t), k=1), F.col("y1") + F.floor((F.col("y2") - F.col("y1")) * 0.4), 0.02
    ),
    f"""WITH {_FIRST}, s AS (SELECT *, y1 + floor((y2 - y1) * 0.4::DOUBLE) AS cut, floor((y2 - y1) * 0.02::DOUBLE) AS gap FROM firsts)
      SELECT image_id, 0 AS strip_id, x1, y1, x2, CAST(greatest(y1, cut - gap) AS INTEGER) AS y2 FROM s
      UNION ALL SELECT image_id, 1, x1, CAST(least(y2, cut + gap) AS INTEGER), x2, y2 FROM s""",
)

# --- row profiles -------------------------------------------------------------
# One box per image: the whole frame.


def _frame_boxes(t):
    return t.frames.select(
        "image_id", F.lit(0).alias("box_id"), F.lit(0).alias("x1"), F.lit(0).alias("y1"),
        F.col("width").alias("x2"), F.col("height").alias("y2"),
    )


def _brightness(t):
    return runs.row_brightness(t.pixels.withColumn("v", F.greatest("r", "g", "b")), _frame_boxes(t))


_BRIGHT = """dense AS (SELECT image_id, unnest(generate_series(0, height - 1)) AS row FROM frames),
  lit AS (SELECT image_id, y AS row, avg(v) AS v FROM (SELECT image_id, y, x, max(greatest(r, g, b)) AS v FROM pixels
    WHERE in_mask AND greatest(r, g, b) > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
  bright AS (SELECT d.image_id, d.row, coalesce(l.v, 0) AS brightness FROM dense d LEFT JOIN lit l USING (image_id, row))"""
# Every frame has 50 rows, so one mirror on each side covers the radius of 20.
_WEIGHTS = """weights AS (SELECT k, w / sum(w) OVER () AS w FROM (SELECT k, exp(-0.5::DOUBLE * (k / 5.0::DOUBLE) ** 2) AS w FROM
    (SELECT unnest(generate_series(-20, 20)) AS k))),
  smooth AS (SELECT b.image_id, b.row, sum(w.w * s.brightness) AS smoothed FROM bright b, weights w, bright s
    WHERE s.image_id = b.image_id AND s.row = CASE WHEN b.row + w.k < 0 THEN -1 - (b.row + w.k)
      WHEN b.row + w.k > 49 THEN 99 - (b.row + w.k) ELSE b.row + w.k END GROUP BY 1, 2)"""

register(
    "row_brightness",
    lambda t: rounded(_brightness(t).select("image_id", "row", "brightness")),
    f"WITH {_BRIGHT} SELECT image_id, row, round(brightness, 6) AS brightness FROM bright",
)
register(
    "row_green_counts",
    lambda t: runs.row_profile(t.leaf_runs, _frame_boxes(t)).select("image_id", "row", "pixels"),
    """WITH dense AS (SELECT image_id, unnest(generate_series(0, height - 1)) AS row FROM frames)
      SELECT d.image_id, d.row, CAST(coalesce(sum(x_end - x_start + 1), 0) AS BIGINT) AS pixels
      FROM dense d LEFT JOIN leaf_runs r ON r.image_id = d.image_id AND r.y = d.row GROUP BY 1, 2""",
)
register(
    "brightness_moving_mean",
    lambda t: rounded(
        detection.smooth_mean(_brightness(t), ["image_id", "box_id"]).select("image_id", "row", "smoothed")
    ),
    f"""WITH {_BRIGHT} SELECT image_id, row, round(sum(brightness) OVER (PARTITION BY image_id ORDER BY row
      ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11, 6) AS smoothed FROM bright""",
)
register(
    "brightness_middle_third",
    lambda t: rounded(
        detection.middle_third(_brightness(t), ["image_id", "box_id"]).select("image_id", "row", "brightness")
    ),
    f"WITH {_BRIGHT} SELECT image_id, row, round(brightness, 6) AS brightness FROM bright WHERE row BETWEEN 16 AND 32",
)
register(
    "brightness_gaussian",
    lambda t: rounded(
        detection.smooth_gaussian(_brightness(t), ["image_id", "box_id"]).select("image_id", "row", "smoothed")
    ),
    f"WITH {_BRIGHT}, {_WEIGHTS} SELECT image_id, row, round(smoothed, 6) AS smoothed FROM smooth",
)
register(
    "midrib_rows",
    lambda t: detection.midrib_row(
        rounded(detection.smooth_gaussian(_brightness(t), ["image_id", "box_id"]), 9, ["smoothed"]),
        ["image_id", "box_id"],
    ).select("image_id", "midrib_row"),
    f"""WITH {_BRIGHT}, {_WEIGHTS}, s AS (SELECT image_id, row, round(smoothed, 9) AS smoothed FROM smooth),
      m AS (SELECT image_id, avg(smoothed) FILTER (WHERE smoothed > 0) AS mean FROM s GROUP BY 1),
      p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY smoothed DESC, row) AS n FROM s WHERE row BETWEEN 16 AND 32)
      SELECT p.image_id, CAST(p.row AS INTEGER) AS midrib_row FROM p JOIN m USING (image_id)
      WHERE n = 1 AND smoothed > coalesce(mean, 0) * 1.05::DOUBLE""",
)
register(
    "valley_rows",
    lambda t: detection.valley_row(
        runs.row_profile(t.leaf_runs, _frame_boxes(t)).withColumn("box_width", F.lit(150)), ["image_id", "box_id"]
    ).select("image_id", "valley_row"),
    """WITH dense AS (SELECT image_id, unnest(generate_series(0, height - 1)) AS row FROM frames),
      prof AS (SELECT d.image_id, d.row, -coalesce(sum(x_end - x_start + 1), 0) AS v
        FROM dense d LEFT JOIN leaf_runs r ON r.image_id = d.image_id AND r.y = d.row GROUP BY 1, 2),
      marks AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS fresh FROM prof WINDOW w AS (PARTITION BY image_id ORDER BY row)),
      flats AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id ORDER BY row) AS flat FROM marks),
      level AS (SELECT image_id, flat, min(row) AS a, max(row) AS b, min(v) AS v FROM flats GROUP BY 1, 2),
      shape AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM level WINDOW w AS (PARTITION BY image_id ORDER BY flat)),
      peaks AS (SELECT * FROM shape WHERE v > before AND v > after),
      walls AS (SELECT p.image_id, p.flat, p.a, p.b, p.v, max(l.flat) FILTER (WHERE l.flat < p.flat AND l.v > p.v) AS lw,
        min(l.flat) FILTER (WHERE l.flat > p.flat AND l.v > p.v) AS rw FROM peaks p JOIN level l USING (image_id) GROUP BY ALL),
      prom AS (SELECT w.image_id, (w.a + w.b) // 2 AS row, w.v - greatest(
          min(l.v) FILTER (WHERE l.flat < w.flat AND l.flat > coalesce(w.lw, -1)),
          min(l.v) FILTER (WHERE l.flat > w.flat AND l.flat < coalesce(w.rw, 1000))) AS p
        FROM walls w JOIN level l USING (image_id) GROUP BY w.image_id, w.flat, w.a, w.b, w.v),
      kept AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n
        FROM prom WHERE p >= 15)
      SELECT image_id, CAST(row AS INTEGER) AS valley_row FROM kept WHERE k = n // 2""",
)
