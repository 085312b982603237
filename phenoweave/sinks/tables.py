"""Writers with the fixed column orders and document forms of the outputs.

Tables are written in parallel as folders. Documents that nest a whole result
in one JSON object exist only where the result has a small fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoweave import schemas
from phenoweave.functions.numeric import array_to_wide
from phenoweave.operators.catalog import classify_boxes, fallback_report, skipped_report
from phenoweave.operators.embeddings import cluster_sizes, global_stats
from phenoweave.operators.reconstruction import genotype_report, overall_report
from phenoweave.operators.splits import group_lists, split_summary
from phenoweave.operators.topk import most_common
from phenoweave.session import durable

MAX_DOCUMENT_ENTRIES = 10_000


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_measurements(
    measurements: DataFrame, path: str, with_subdirectory: bool = False, identifier_as_subdirectory: bool = False,
    form: str = "csv",
) -> None:
    """Fixed column order. ``identifier_as_subdirectory`` repeats the image name there."""
    out = measurements
    if with_subdirectory and identifier_as_subdirectory:
        out = out.withColumn("subdirectory", F.col("image_name"))
    out = out.select(*_columns(schemas.ALL_MEASUREMENTS if with_subdirectory else schemas.MEASUREMENTS))
    _write_csv(out, path) if form == "csv" else out.write.mode("overwrite").parquet(path)


def write_skip_reports(detections: DataFrame, skipped_path: str, fallback_path: str, min_boxes: int = 2, max_boxes: int = 2) -> None:
    """Both reports from one classification, which is written once."""
    classified = durable(classify_boxes(detections, min_boxes, max_boxes), "box-classes")
    _write_csv(skipped_report(classified), skipped_path)
    _write_csv(fallback_report(classified), fallback_path)


def write_reprocessing(results: DataFrame, path: str) -> None:
    _write_csv(results.select(*_columns(schemas.REPROCESSED)), path)


def write_splits(images: DataFrame, assigned: DataFrame, group: str, images_path: str, groups_path: str) -> None:
    """Image rows by split, and the sorted group list of each split as JSON lines."""
    images.write.mode("overwrite").partitionBy("split").parquet(images_path)
    lists = group_lists(assigned, group)
    (
        lists.repartitionByRange("split", "position")
        .sortWithinPartitions("split", "position")
        .write.mode("overwrite")
        .partitionBy("split")
        .json(groups_path)
    )


def write_split_summary(images: DataFrame, group: str, path: str) -> None:
    _write_csv(split_summary(images, group), path)


def write_wide_embeddings(embeddings: DataFrame, path: str, dimension: int = 256) -> None:
    meta = _columns(schemas.EMBEDDING_META)
    _write_csv(embeddings.select(*meta, *array_to_wide("embedding", dimension)), path)


def write_embedding_summary(embeddings: DataFrame, metadata_path: str, summary_path: str) -> None:
    """Metadata rows as JSON lines, and one summary document with the top 20 genotypes."""
    embeddings.drop("embedding").write.mode("overwrite").json(metadata_path)
    top = most_common(embeddings, "genotype", 20).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("images")).alias("k"), "genotype", "images"))).alias("t")
    ).select(F.transform("t", lambda s: F.struct(s["genotype"].alias("genotype"), s["images"].alias("images"))).alias("t"))
    distinct = embeddings.agg(
        F.struct(
            F.count_distinct("genotype").alias("genotypes"), F.count_distinct("device").alias("devices")
        ).alias("d")
    )
    (
        global_stats(embeddings)
        .withColumn("_d", distinct.scalar())
        .withColumn("genotype_distribution", top.scalar())
        .select("*", F.col("_d.genotypes").alias("num_genotypes"), F.col("_d.devices").alias("num_devices"))
        .drop("_d")
        .write.mode("overwrite")
        .json(summary_path)
    )


def append_training_log(rows: DataFrame, path: str) -> None:
    rows.select(*_columns(schemas.TRAINING_LOG)).write.mode("append").csv(path, header=True)


def write_lab_statistics(statistics: DataFrame, path: str, channels=("L", "a", "b")) -> None:
    """One JSON document with the mean and deviation arrays."""
    (
        statistics.select(
            F.array(*[f"mean_{c}" for c in channels]).alias("lab_mean"),
            F.array(*[f"std_{c}" for c in channels]).alias("lab_std"),
        )
        .write.mode("overwrite")
        .json(path)
    )


def write_clusters(clusters: DataFrame, method: str, parameters: dict, assignment_path: str, summary_path: str) -> None:
    """Assignments as Parquet; sizes as JSON, nested in one document when they are few.

    Beyond that each cluster is a line, which also has the method and the parameters.
    """
    clusters.write.mode("overwrite").parquet(assignment_path)
    sizes = durable(cluster_sizes(clusters.sparkSession.read.parquet(assignment_path)), "cluster-sizes")
    about = F.struct(*[F.lit(v).alias(k) for k, v in {"method": method, **parameters}.items()]).alias("parameters")
    if sizes.limit(MAX_DOCUMENT_ENTRIES + 1).count() > MAX_DOCUMENT_ENTRIES:
        sizes.select(F.lit(method).alias("method"), about, "*").write.mode("overwrite").json(summary_path)
        return
    (
        sizes.agg(
            F.lit(method).alias("method"),
            F.max("n_clusters").alias("n_clusters"),
            about,
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct(F.col("cluster").cast("string"), "images")))
            ).alias("cluster_sizes"),
        )
        .write.mode("overwrite")
        .json(summary_path)
    )


def write_metrics_report(metrics: DataFrame, path: str, k: int = 10) -> None:
    """One document: overall statistics and a map of the k largest genotypes."""
    per_genotype = genotype_report(metrics, k).agg(
        F.map_from_entries(
            F.collect_list(F.struct("genotype", F.struct("count", "mean_mse", "mean_psnr")))
        ).alias("per_genotype")
    )
    overall = overall_report(metrics)
    (
        overall.select(F.struct(*overall.columns).alias("overall"))
        .withColumn("per_genotype", per_genotype.scalar())
        .write.mode("overwrite")
        .json(path)
    )


def write_association(table: DataFrame, table_path: str, list_path: str) -> None:
    """Phenotype table, and its distinct genotypes without a header."""
    _write_csv(table, table_path)
    table.select("genotype").distinct().write.mode("overwrite").text(list_path)


def write_failed(failed: DataFrame, path: str, shown: int = 10) -> DataFrame:
    """All failed paths as text; returns the first few for display."""
    failed.select(F.col("image_path").alias("value")).write.mode("overwrite").text(path)
    return failed.select("image_path").orderBy("image_path").limit(shown)


def write_masks(runs: DataFrame, boxes: DataFrame, runs_path: str, boxes_path: str) -> None:
    """Mask runs and box sidecars by device."""
    runs.write.mode("overwrite").partitionBy("device").parquet(runs_path)
    boxes.write.mode("overwrite").partitionBy("device").parquet(boxes_path)
