"""Reconstruction metrics, reports, losses and distribution numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoweave.operators import reconstruction, topk
from phenoweave.registry.core import register, rounded

_METRICS = ("mse", "mae", "psnr", "L_mae", "a_mae", "b_mae")
_ROUND = ", ".join(f'round("{m}", 6) AS "{m}"' for m in _METRICS)

register(
    "reconstruction_metrics",
    lambda t: rounded(reconstruction.image_metrics(t.recon_pixels)),
    f"SELECT image_id, {_ROUND} FROM image_errors",
)
register(
    "reconstruction_mse",
    lambda t: rounded(reconstruction.mean_squared_error(t.recon_pixels), 9),
    "SELECT round(avg((target - recon) ** 2), 9) AS mse FROM recon_pixels",
)
register(
    "reconstruction_overall",
    lambda t: rounded(reconstruction.overall_report(t.recon_metrics)),
    """SELECT round(avg(mse), 6) AS mean_mse, round(stddev_pop(mse), 6) AS std_mse, round(avg(mae), 6) AS mean_mae,
      round(avg(psnr), 6) AS mean_psnr, round(stddev_pop(psnr), 6) AS std_psnr, count(*) AS num_samples FROM recon_metrics""",
)
register(
    "reconstruction_by_genotype",
    lambda t: rounded(reconstruction.genotype_report(t.recon_metrics)),
    """SELECT genotype, count(*) AS count, round(avg(mse), 6) AS mean_mse, round(avg(psnr), 6) AS mean_psnr FROM recon_metrics
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
register(
    "best_and_worst_reconstructions",
    lambda t: topk.best_and_worst(rounded(t.recon_metrics, 9), "mse", "image_id").select("image_id", "mse", "side"),
    """(SELECT image_id, round(mse, 9) AS mse, 'best' AS side FROM recon_metrics ORDER BY round(mse, 9), image_id LIMIT 4)
      UNION ALL (SELECT image_id, round(mse, 9), 'worst' FROM recon_metrics ORDER BY round(mse, 9) DESC, image_id DESC LIMIT 4)""",
)
register(
    "psnr_box_plot_by_device",
    lambda t: rounded(topk.box_plot_numbers(rounded(t.recon_metrics, 9), "device", "psnr")),
    """WITH m AS (SELECT device, round(psnr, 9) AS v FROM recon_metrics),
      q AS (SELECT device, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) AS q3 FROM m GROUP BY 1)
      SELECT device, count(*) AS n, round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS low_whisker, round(q1, 6) AS q1,
        round(md, 6) AS median, round(q3, 6) AS q3, round(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS high_whisker
      FROM m JOIN q USING (device) GROUP BY device, q1, md, q3""",
)
register(
    "channel_error_box_plot",
    lambda t: rounded(
        topk.box_plot_numbers(
            rounded(t.recon_metrics, 9).unpivot("image_id", ["L_mae", "a_mae", "b_mae"], "channel", "error"), "channel", "error"
        )
    ),
    """WITH m AS (SELECT unnest(['L_mae', 'a_mae', 'b_mae']) AS channel, round(unnest(["L_mae", a_mae, b_mae]), 9) AS v FROM recon_metrics),
      q AS (SELECT channel, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) AS q3 FROM m GROUP BY 1)
      SELECT channel, count(*) AS n, round(least(q1, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))), 6) AS low_whisker, round(q1, 6) AS q1,
        round(md, 6) AS median, round(q3, 6) AS q3, round(greatest(q3, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))), 6) AS high_whisker
      FROM m JOIN q USING (channel) GROUP BY channel, q1, md, q3""",
)
register(
    "area_histogram",
    lambda t: topk.histogram(t.strips, "area_px", 50).select("bin", "n"),
    """WITH b AS (SELECT min(area_px)::DOUBLE AS lo, max(area_px)::DOUBLE AS hi FROM strips),
      c AS (SELECT CAST(least(floor((area_px - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM strips, b GROUP BY 1)
      SELECT CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, 49)) AS k) LEFT JOIN c ON c.bin = k""",
)

# One row per lineitem as a pixel of three channels with Lab values in the weight's range.
_LOSS_PIXELS = """loss_pixels AS (SELECT l_orderkey AS image_id, l_tax + 0.0 AS t0, l_discount + 0.0 AS p0, l_quantity / 50 AS t1,
    l_linenumber / 7.0::DOUBLE AS p1, 0.5::DOUBLE AS t2, l_tax * 2 AS p2, l_quantity - 40 AS a, (l_partkey % 60)::DOUBLE AS b,
    l_returnflag <> 'R' AS in_mask FROM lineitem),
  weighed AS (SELECT *, (p0 - t0) ** 2 + (p1 - t1) ** 2 + (p2 - t2) ** 2 AS e,
    1 + least(greatest(greatest(a + 30, 0) / 50 + greatest(b - 30, 0) / 50, 0), 1) AS w FROM loss_pixels)"""


def _loss_pixels(t):
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_tax") + 0.0).alias("t0"),
        (F.col("l_discount") + 0.0).alias("p0"),
        (F.col("l_quantity") / 50).alias("t1"),
        (F.col("l_linenumber") / 7.0).alias("p1"),
        F.lit(0.5).alias("t2"),
        (F.col("l_tax") * 2).alias("p2"),
        (F.col("l_quantity") - 40).alias("a"),
        (F.col("l_partkey") % 60).cast("double").alias("b"),
        (F.col("l_returnflag") != "R").alias("in_mask"),
    )


_MEAN_WEIGHT = "round(coalesce(avg(w) FILTER (WHERE in_mask), 1), 6) AS mean_weight"
register(
    "disease_weighted_loss",
    lambda t: rounded(reconstruction.disease_loss(_loss_pixels(t))),
    f"""WITH {_LOSS_PIXELS} SELECT image_id, round(sum(CASE WHEN in_mask THEN e * w ELSE 0 END)
      / (sum(CASE WHEN in_mask THEN w ELSE 0 END) + 1e-8), 6) AS reconstruction_loss, {_MEAN_WEIGHT} FROM weighed GROUP BY 1""",
)
register(
    "disease_weighted_loss_cropped",
    lambda t: rounded(reconstruction.disease_loss(_loss_pixels(t), mask_weights=False)),
    f"""WITH {_LOSS_PIXELS} SELECT image_id, round(sum(e * w) / (sum(w) + 1e-8), 6) AS reconstruction_loss, {_MEAN_WEIGHT}
      FROM weighed GROUP BY 1""",
)
register(
    "masked_mse_loss",
    lambda t: rounded(reconstruction.disease_loss(_loss_pixels(t), uniform=True).drop("mean_weight")),
    f"""WITH {_LOSS_PIXELS} SELECT image_id, round(sum(CASE WHEN in_mask THEN e ELSE 0 END) / (count(*) FILTER (WHERE in_mask) + 1e-8), 6)
      AS reconstruction_loss FROM weighed GROUP BY 1""",
)
register(
    "all_pixels_mse_loss",
    lambda t: rounded(reconstruction.disease_loss(_loss_pixels(t), all_pixels=True).drop("mean_weight")),
    f"WITH {_LOSS_PIXELS} SELECT image_id, round(sum(e) / (count(*) * 3), 6) AS reconstruction_loss FROM weighed GROUP BY 1",
)
register(
    "loss_with_embedding_penalty",
    lambda t: rounded(
        reconstruction.add_l1(
            reconstruction.disease_loss(_loss_pixels(t)), t.embeddings.select("image_id", "embedding"), weight=0.01
        )
    ),
    f"""WITH {_LOSS_PIXELS}, l AS (SELECT image_id, sum(CASE WHEN in_mask THEN e * w ELSE 0 END)
        / (sum(CASE WHEN in_mask THEN w ELSE 0 END) + 1e-8) AS r, {_MEAN_WEIGHT} FROM weighed GROUP BY 1),
      z AS (SELECT image_id, avg(abs(x::DOUBLE)) * 0.01::DOUBLE AS p FROM (SELECT image_id, unnest(embedding) AS x FROM vectors) GROUP BY 1)
      SELECT image_id, round(r, 6) AS reconstruction_loss, mean_weight, round(coalesce(p, 0), 6) AS l1_loss,
        round(r + coalesce(p, 0), 6) AS total_loss FROM l LEFT JOIN z USING (image_id)""",
)
