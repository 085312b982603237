"""Catalogue, parsing, existence joins and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoweave.functions import parse
from phenoweave.operators import catalog, topk
from phenoweave.registry.core import register, rounded

register(
    "parse_image_names",
    lambda t: t.images.select(
        "image_id",
        parse.leading_plot(F.col("filename")).alias("plot"),
        parse.device_of(F.col("image_name")).alias("device"),
        parse.plot_of(F.col("image_name")).alias("name_plot"),
        parse.stem(parse.file_name(F.col("image_path"))).alias("stem"),
        parse.full_identifier(F.concat(F.lit("device"), F.col("device")), parse.stem(F.col("filename"))).alias("identifier"),
        parse.mask_directory("/masks", F.col("device"), parse.stem(F.col("filename"))).alias("mask_dir"),
    ),
    """SELECT image_id, plot, CAST(device AS VARCHAR) AS device, plot AS name_plot,
      plot || '_LeafPhotoA_' || image_id AS stem, image_name AS identifier, '/masks/' || image_name AS mask_dir FROM images""",
)

register(
    "parse_urls_without_plot",
    lambda t: t.read("pages").select(
        "page_id",
        parse.leading_plot(parse.file_name(F.col("url"))).alias("plot"),
        parse.truncate_label(F.col("url"), 20).alias("label"),
        parse.stem(parse.file_name(F.col("url"))).alias("stem"),
    ),
    r"""SELECT page_id, TRY_CAST(nullif(regexp_extract(regexp_extract(url, '([^/]+)/?$', 1), '^(\d+)_', 1), '') AS INTEGER) AS plot,
      substring(url, 1, 20) AS label,
      regexp_replace(regexp_extract(url, '([^/]+)/?$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages""",
)

register(
    "strip_number_and_factor",
    lambda t: t.strips.select(
        "image_id",
        parse.strip_number(F.format_string("strip_%04d_mask.png", F.col("strip_id"))).alias("strip_id"),
        parse.as_factor(F.col("strip_id")).alias("strip_factor"),
    ),
    "SELECT image_id, strip_id, CAST(strip_id AS VARCHAR) AS strip_factor FROM strips",
)

register(
    "parse_box_text",
    lambda t: t.strips.withColumn("box", parse.box_from_text(F.col("box_coords"))).select(
        "image_id", "strip_id", *[F.col("box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    ),
    """SELECT image_id, strip_id, CAST(p[1] AS INTEGER) AS x1, CAST(p[2] AS INTEGER) AS y1, CAST(p[3] AS INTEGER) AS x2,
      CAST(p[4] AS INTEGER) AS y2 FROM (SELECT *, string_split(replace(replace(box_coords, '[', ''), ']', ''), ', ') AS p FROM strips)""",
)

register(
    "images_with_both_masks",
    lambda t: catalog.with_both_masks(t.images, t.raw_runs).select("image_id", "image_name"),
    """SELECT image_id, image_name FROM images WHERE image_id IN (
      SELECT image_id FROM raw_runs WHERE strip_id IN (0, 1) GROUP BY 1 HAVING count(DISTINCT strip_id) = 2)""",
)

register(
    "genotype_lookup_last_duplicate",
    lambda t: catalog.with_genotype(
        t.images,
        t.field_map.select((F.col("plot") % 700).alias("plot"), "genotype", F.col("plot").alias("line")),
        order="line",
    ).select("image_id", "plot", "genotype"),
    """SELECT i.image_id, i.plot, m.genotype FROM images i
      JOIN (SELECT plot % 700 AS plot, arg_max(genotype, plot) AS genotype FROM field_map GROUP BY 1) m ON m.plot = i.plot""",
)

register(
    "usable_images",
    lambda t: catalog.usable_images(t.images, t.raw_runs, t.field_map).select(
        "image_id", "device", "plot", "genotype", "filename", "image_path"
    ),
    """SELECT image_id, device, plot, genotype, filename, image_path FROM image_genotypes WHERE image_id IN (
      SELECT image_id FROM raw_runs GROUP BY 1 HAVING count(DISTINCT strip_id) = 2)""",
)

register(
    "strips_with_field_map",
    lambda t: rounded(
        catalog.with_field_map(
            t.strips.withColumn("plot", parse.plot_of(F.col("image_name"))).withColumn(
                "device", parse.device_of(F.col("image_name"))
            ),
            t.field_map.filter("plot % 5 <> 0"),
        ).select("image_id", "strip_id", "device", "plot", "genotype", "row", "range", "mean_height_px", "sam_score")
    ),
    """SELECT s.image_id, s.strip_id, split_part(s.image_name, '_', 1)[7:] AS device, i.plot, f.genotype, f."row", f."range",
      round(s.mean_height_px, 6) AS mean_height_px, round(s.sam_score, 6) AS sam_score
      FROM strips s JOIN images i USING (image_id) LEFT JOIN (SELECT * FROM field_map WHERE plot % 5 <> 0) f ON f.plot = i.plot""",
)

register(
    "pending_images",
    lambda t: catalog.pending(t.images, t.raw_runs).select("image_id", "image_path"),
    "SELECT image_id, image_path FROM images WHERE image_id NOT IN (SELECT image_id FROM raw_runs)",
)

register(
    "reused_measurements",
    lambda t: catalog.reusable(t.strips, t.images.filter("device <= 3")).select("image_id", "strip_id", "area_px"),
    "SELECT image_id, strip_id, area_px FROM strips WHERE image_id IN (SELECT image_id FROM images WHERE device <= 3)",
)

register(
    "combined_measurements",
    lambda t: catalog.reusable(t.strips, t.images.filter("device <= 3"))
    .select("image_id", "strip_id", "area_px", F.lit("reused").alias("origin"))
    .unionByName(
        t.strips.join(t.images.filter("device > 3").select("image_id"), "image_id", "left_semi").select(
            "image_id", "strip_id", "area_px", F.lit("new").alias("origin")
        )
    ),
    """SELECT s.image_id, s.strip_id, s.area_px, CASE WHEN device <= 3 THEN 'reused' ELSE 'new' END AS origin
      FROM strips s JOIN images USING (image_id)""",
)

register(
    "classify_box_counts",
    lambda t: catalog.classify_boxes(t.detections).select(
        "image_id", "num_boxes_detected", "outcome", "reason", "needs_fallback"
    ),
    "SELECT image_id, num_boxes_detected, outcome, reason, needs_fallback FROM classified",
)

register(
    "skipped_images",
    lambda t: catalog.skipped_report(catalog.classify_boxes(t.detections)),
    "SELECT image_path, subdirectory, image_name, num_boxes_detected, reason FROM classified WHERE outcome = 'skipped'",
)

register(
    "fallback_images",
    lambda t: catalog.fallback_report(catalog.classify_boxes(t.detections)),
    """SELECT image_path, subdirectory, image_name, num_boxes_detected, 'fallback_boxes_needed' AS reason
      FROM classified WHERE needs_fallback""",
)

register(
    "run_summary",
    lambda t: catalog.run_summary(
        catalog.classify_boxes(t.detections, 2, 5).join(
            t.strips.groupBy("image_id").agg(F.count(F.lit(1)).alias("strips")), "image_id", "left"
        ),
        already_done=F.col("image_id") % 10 == 0,
        strips=F.col("strips"),
    ),
    """SELECT count(*) AS found, count(*) FILTER (WHERE NOT done AND num_boxes_detected BETWEEN 2 AND 5) AS successful,
      count(*) FILTER (WHERE NOT done AND num_boxes_detected < 0) AS failed, count(*) FILTER (WHERE done) AS already_processed,
      count(*) FILTER (WHERE NOT done AND num_boxes_detected >= 0 AND num_boxes_detected NOT BETWEEN 2 AND 5) AS wrong_box_count,
      (SELECT count(*) FROM strips) AS strips_measured
      FROM (SELECT *, image_id % 10 = 0 AS done FROM detections)""",
)

register(
    "reprocessing_results",
    lambda t: catalog.reprocessing_results(
        catalog.skipped_report(catalog.classify_boxes(t.detections)), t.redetections
    ),
    "SELECT image_path, subdirectory, image_name, old_num_boxes, new_num_boxes, status, reason FROM reprocessed",
)

register(
    "reprocessing_summary",
    lambda t: rounded(
        catalog.reprocessing_summary(
            catalog.reprocessing_results(
                catalog.skipped_report(catalog.classify_boxes(t.detections)), t.redetections
            )
        )
    ),
    """SELECT count(*) AS reprocessed, count(*) FILTER (WHERE status <> 'failed') AS successful,
      count(*) FILTER (WHERE status = 'failed') AS failed,
      count(*) FILTER (WHERE status = 'success_now_correct') AS now_correct,
      count(*) FILTER (WHERE status = 'success_still_wrong') AS still_wrong,
      round(100.0 * count(*) FILTER (WHERE status = 'success_now_correct')
        / nullif(count(*) FILTER (WHERE status <> 'failed'), 0), 6) AS improvement_rate FROM reprocessed""",
)

register(
    "first_skipped_images",
    lambda t: topk.first_rows(catalog.skipped_report(catalog.classify_boxes(t.detections)), ["image_path"], 50),
    """SELECT image_path, subdirectory, image_name, num_boxes_detected, reason FROM classified WHERE outcome = 'skipped'
      ORDER BY image_path LIMIT 50""",
)

register(
    "failed_images",
    lambda t: catalog.classify_boxes(t.detections).filter("outcome = 'failed'").select("image_path"),
    "SELECT image_path FROM classified WHERE outcome = 'failed'",
)
