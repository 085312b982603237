"""Image catalogue: existence joins, field map lookup, run bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenoweave.functions import parse
from phenoweave.functions.numeric import ratio_percent


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Raise when ``key`` repeats; shows a few of the offending keys."""
    repeated = [
        row[0] for row in df.groupBy(key).count().filter("count > 1").orderBy(key).select(key).limit(10).collect()
    ]
    if repeated:
        raise ValueError(f"{key} must be unique; repeated: {repeated}")
    return df


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` per key (a map-side combined aggregate)."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in rest])
    )


def has_both_masks(masks: DataFrame) -> DataFrame:
    """image_id of images with a mask for strip 0 and for strip 1."""
    return (
        masks.filter(F.col("strip_id").isin(0, 1))
        .groupBy("image_id")
        .agg(F.max(F.col("strip_id") == 0).alias("_s0"), F.max(F.col("strip_id") == 1).alias("_s1"))
        .filter("_s0 and _s1")
        .select("image_id")
    )


def with_both_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    return images.join(has_both_masks(masks), "image_id", "left_semi")


def with_genotype(images: DataFrame, field_map: DataFrame, order: str | None = None) -> DataFrame:
    """Inner lookup of the plot's genotype; the last duplicate plot wins by ``order``."""
    plots = last_per_key(field_map, "plot", order) if order else assert_unique(field_map, "plot")
    return images.join(plots.select("plot", "genotype"), "plot")


def with_field_map(strips: DataFrame, field_map: DataFrame) -> DataFrame:
    """Left join on plot, many to one; duplicate plots in the map are an error."""
    return strips.join(assert_unique(field_map, "plot"), "plot", "left")


def usable_images(images: DataFrame, masks: DataFrame, field_map: DataFrame, order: str | None = None) -> DataFrame:
    """Images whose name carries a plot, with both strip masks and a genotype."""
    named = images.withColumn("plot", parse.leading_plot(F.col("filename"))).filter("plot is not null")
    return with_genotype(with_both_masks(named, masks), field_map, order)


def pending(images: DataFrame, done: DataFrame, on: str = "image_id") -> DataFrame:
    return images.join(done.select(on).distinct(), on, "left_anti")


def reusable(measurements: DataFrame, images: DataFrame, on: str = "image_id") -> DataFrame:
    """Earlier measurements of images that are skipped as already processed."""
    return measurements.join(images.select(on).distinct(), on, "left_semi")


def classify_boxes(detections: DataFrame, min_boxes: int = 2, max_boxes: int = 2) -> DataFrame:
    """Add ``outcome`` (failed / skipped / ready), ``reason`` and ``needs_fallback``.

    A negative count is a detection error. Too few boxes set both the fallback
    flag and the skip, as the two reports overlap on purpose.
    """
    n = F.col("num_boxes_detected")
    return detections.select(
        "*",
        F.when(n < 0, "failed").when((n < min_boxes) | (n > max_boxes), "skipped").otherwise("ready").alias("outcome"),
        F.when(n >= 0, parse.skip_reason(n, min_boxes, max_boxes)).alias("reason"),
        ((n >= 0) & (n < 2)).alias("needs_fallback"),
    )


_REPORT = ["image_path", "subdirectory", "image_name", "num_boxes_detected", "reason"]


def skipped_report(classified: DataFrame) -> DataFrame:
    return classified.filter("outcome = 'skipped'").select(*_REPORT)


def fallback_report(classified: DataFrame) -> DataFrame:
    return classified.filter("needs_fallback").withColumn("reason", F.lit("fallback_boxes_needed")).select(*_REPORT)


def run_summary(classified: DataFrame, already_done: Column | None = None, strips: Column | None = None) -> DataFrame:
    """One row of counts for a processing run."""
    done = F.lit(False) if already_done is None else already_done
    is_outcome = lambda name: F.count_if(~done & (F.col("outcome") == name)).cast("bigint")
    return classified.agg(
        F.count(F.lit(1)).alias("found"),
        is_outcome("ready").alias("successful"),
        is_outcome("failed").alias("failed"),
        F.count_if(done).cast("bigint").alias("already_processed"),
        is_outcome("skipped").alias("wrong_box_count"),
        F.coalesce(F.sum(F.lit(0) if strips is None else strips), F.lit(0)).cast("bigint").alias("strips_measured"),
    )


def reprocessing_results(skipped: DataFrame, detections: DataFrame, keys: Sequence[str] = ("image_path",)) -> DataFrame:
    """Left join of skipped images with a new detection, with status and reason.

    ``detections`` holds ``new_num_boxes`` (null when it could not be read) and
    ``error`` (null on success); images absent from it were not found.
    """
    found = detections.withColumn("_found", F.lit(True))
    joined = skipped.join(found, list(keys), "left")
    missing, error, new = F.col("_found").isNull(), F.col("error"), F.col("new_num_boxes")
    status = (
        F.when(missing | error.isNotNull(), "failed")
        .when(new.isNull(), "unknown")
        .when(new == 2, "success_now_correct")
        .otherwise("success_still_wrong")
    )
    reason = (
        F.when(missing, "image_not_found")
        .when(error.isNotNull(), error)
        .when(new.isNull(), "could_not_parse_output")
        .when(new == 2, "now_detects_2_boxes")
        .otherwise(F.format_string("still_detects_%d_boxes", new))
    )
    return joined.select(
        "image_path",
        "subdirectory",
        "image_name",
        F.col("num_boxes_detected").alias("old_num_boxes"),
        F.when(missing | error.isNotNull() | new.isNull(), -1).otherwise(new).cast("int").alias("new_num_boxes"),
        status.alias("status"),
        reason.alias("reason"),
    )


def reprocessing_summary(results: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") != "failed").cast("bigint")
    fixed = F.count_if(F.col("status") == "success_now_correct").cast("bigint")
    return results.agg(
        F.count(F.lit(1)).alias("reprocessed"),
        ok.alias("successful"),
        F.count_if(F.col("status") == "failed").cast("bigint").alias("failed"),
        fixed.alias("now_correct"),
        F.count_if(F.col("status") == "success_still_wrong").cast("bigint").alias("still_wrong"),
        ratio_percent(fixed, ok).alias("improvement_rate"),
    )
