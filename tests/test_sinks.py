import json

from pyspark.sql import functions as F

from phenoweave.operators import catalog, embeddings, splits
from phenoweave.sinks import tables as sinks
from phenoweave.sources import tables as sources


def documents(path):
    return [json.loads(line) for f in path.glob("*.json") for line in f.read_text().splitlines()]


def test_skip_reports(spark, tables, tmp_path):
    sinks.write_skip_reports(tables.detections, str(tmp_path / "skipped"), str(tmp_path / "fallback"))
    skipped = sources.read_skipped(spark, str(tmp_path / "skipped"))
    fallback = sources.read_skipped(spark, str(tmp_path / "fallback"))
    n = F.col("num_boxes_detected")
    assert skipped.count() == tables.detections.filter((n >= 0) & (n != 2)).count()
    assert fallback.count() == tables.detections.filter(n.isin(0, 1)).count()
    # With two as the minimum every fallback image is skipped too.
    assert fallback.join(skipped, "image_path", "left_anti").count() == 0


def test_reprocessing(spark, tables, tmp_path):
    results = catalog.reprocessing_results(
        catalog.skipped_report(catalog.classify_boxes(tables.detections)), tables.redetections
    )
    sinks.write_reprocessing(results, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == results.count()


def test_splits(spark, tables, tmp_path):
    assigned = splits.assign_groups(tables.images, "plot")
    images = splits.split_rows(tables.images, assigned, "plot")
    sinks.write_splits(images, assigned, "plot", str(tmp_path / "images"), str(tmp_path / "groups"))
    sinks.write_split_summary(images, "plot", str(tmp_path / "summary"))
    back = spark.read.parquet(str(tmp_path / "images"))
    assert back.count() == tables.images.count()
    assert splits.leaking_groups(back, "plot").count() == 0
    lists = spark.read.json(str(tmp_path / "groups"))
    assert lists.count() == assigned.count()
    rows = spark.read.csv(str(tmp_path / "summary"), header=True).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test", "TOTAL"}


def test_embedding_files(spark, tables, tmp_path):
    df = tables.embeddings.select(
        F.concat("image_id", F.lit(".jpg")).alias("filename"), F.col("image_id").cast("int").alias("plot"), "genotype", "device",
        F.lit("train").alias("split"), "embedding",
    )
    sinks.write_wide_embeddings(df, str(tmp_path / "wide"), 64)
    back = sources.read_wide_embeddings(spark, str(tmp_path / "wide"), 64)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_embedding_summary(df, str(tmp_path / "meta"), str(tmp_path / "summary"))
    (summary,) = documents(tmp_path / "summary")
    assert summary["num_samples"] == 500 and summary["embedding_dim"] == 64 and summary["num_genotypes"] == 10
    counts = [g["images"] for g in summary["genotype_distribution"]]
    assert counts == sorted(counts, reverse=True)
    assert len(documents(tmp_path / "meta")) == 500


def test_cluster_summary(spark, tables, tmp_path):
    sinks.write_clusters(
        tables.clusters, "kmeans", {"n_clusters": 5, "eps": 0.5, "min_samples": 5}, str(tmp_path / "c"), str(tmp_path / "s")
    )
    (summary,) = documents(tmp_path / "s")
    assert summary["n_clusters"] == 5 and sum(summary["cluster_sizes"].values()) == 500
    assert summary["parameters"] == {"method": "kmeans", "n_clusters": 5, "eps": 0.5, "min_samples": 5}


def test_many_clusters_keep_method_and_parameters(tables, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MAX_DOCUMENT_ENTRIES", 2)
    sinks.write_clusters(tables.clusters, "kmeans", {"n_clusters": 5}, str(tmp_path / "c"), str(tmp_path / "s"))
    lines = documents(tmp_path / "s")
    assert sum(x["images"] for x in lines) == 500 and all(x["method"] == "kmeans" and x["parameters"]["n_clusters"] == 5 for x in lines)


def test_cluster_size_golden(spark):
    # Golden: sizes of the five published clusters sum to the corpus.
    sizes = {0: 1182, 1: 1550, 2: 11, 3: 3131, 4: 76}
    df = spark.createDataFrame([(c, n) for c, n in sizes.items()], "cluster int, n int")
    rows = embeddings.cluster_sizes(df.select("cluster", F.explode(F.sequence(F.lit(1), "n")))).collect()
    assert {r["cluster"]: r["images"] for r in rows} == sizes
    assert sum(r["images"] for r in rows) == 5950 and rows[0]["n_clusters"] == 5


def test_metrics_report(spark, tables, tmp_path):
    sinks.write_metrics_report(tables.recon_metrics, str(tmp_path / "m"))
    (report,) = documents(tmp_path / "m")
    assert report["overall"]["num_samples"] == tables.recon_metrics.count()
    assert len(report["per_genotype"]) == 10


def test_association_logs_failures_and_masks(spark, tables, tmp_path):
    table = spark.createDataFrame([("PI1", 1.0), ("PI1", 2.0), ("PI2", 3.0)], "genotype string, mean_height_px double")
    sinks.write_association(table, str(tmp_path / "t"), str(tmp_path / "l"))
    assert sorted(r[0] for r in sources.read_genotype_list(spark, str(tmp_path / "l")).collect()) == ["PI1", "PI2"]
    failed = spark.createDataFrame([(f"p{i:02d}",) for i in range(12)], "image_path string")
    shown = sinks.write_failed(failed, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 12 and shown.count() == 10
    for epoch in (1, 2):
        row = spark.createDataFrame([(epoch, 1.0, 2.0, 1e-4)], "epoch int, train_loss double, val_loss double, learning_rate double")
        sinks.append_training_log(row, str(tmp_path / "log"))
    assert sources.read_training_log(spark, str(tmp_path / "log")).count() == 2
    runs = tables.leaf_runs.join(tables.images.select("image_id", "device"), "image_id")
    boxes = tables.strips.select("image_id", "strip_id", "box_coords", "sam_score").withColumn("device", F.lit(1))
    sinks.write_masks(runs, boxes, str(tmp_path / "runs"), str(tmp_path / "boxes"))
    pruned = spark.read.parquet(str(tmp_path / "runs")).filter("device = 3")
    assert "PartitionFilters: [isnotnull(device" in pruned._jdf.queryExecution().toString()
    assert spark.read.parquet(str(tmp_path / "runs")).count() == runs.count()
