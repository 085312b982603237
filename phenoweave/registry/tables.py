"""Domain tables derived by Spark from the given tables (whole tables, no subsets)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave.operators.colourfit import REFERENCE_PATCHES
from phenoweave.operators.runs import merge_runs
from phenoweave.session import numeric_batches, tune

FRAME_WIDTH, FRAME_HEIGHT = 150, 50
DETECTION_HEIGHT = 1210
# Tasks that make the patches. A few splits of a small file would each make 24 rows of all their images.
SPREAD = 200


class Tables:
    """Lazy DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        numeric_batches(spark)
        self.sf_dir = str(sf_dir).rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def images(self) -> DataFrame:
        device = (F.col("o_custkey") % 8 + 1).cast("int")
        plot = F.col("o_custkey").cast("int")
        filename = F.concat_ws("_", plot, F.lit("LeafPhotoA"), F.concat(F.col("o_orderkey"), F.lit(".jpg")))
        return self.read("orders").select(
            F.col("o_orderkey").alias("image_id"),
            device.alias("device"),
            plot.alias("plot"),
            filename.alias("filename"),
            F.concat(F.lit("device"), device, F.lit("_"), F.regexp_replace(filename, r"\.jpg$", "")).alias("image_name"),
            F.concat(F.lit("/data/device"), device, F.lit("/"), filename).alias("image_path"),
        )

    @cached_property
    def field_map(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").cast("int").alias("plot"),
            F.concat_ws("-", "c_mktsegment", F.col("c_custkey") % 300).alias("genotype"),
            (F.col("c_custkey") % 30).cast("int").alias("row"),
            F.col("c_nationkey").cast("int").alias("range"),
        )

    @cached_property
    def image_genotypes(self) -> DataFrame:
        return self.images.join(self.field_map, "plot")

    @cached_property
    def strips(self) -> DataFrame:
        """Strip measurements keyed by image name, as the measurement CSV is."""
        q = F.col("l_quantity")
        strip = self.read("lineitem").groupBy(
            F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 2).cast("int").alias("strip_id")
        ).agg(
            F.avg(q).alias("mean_height_px"),
            F.percentile(q, F.lit(0.5)).alias("median_height_px"),
            F.min(q).alias("min_height_px"),
            F.max(q).alias("max_height_px"),
            (F.max(q) - F.min(q)).alias("height_range_px"),
            F.sum(F.floor("l_extendedprice")).cast("bigint").alias("area_px"),
            F.concat(
                F.lit("["), F.min("l_suppkey"), F.lit(", "), F.min(F.col("l_partkey") % 1000), F.lit(", "),
                F.max("l_suppkey") + 100, F.lit(", "), F.max(F.col("l_partkey") % 1000) + 30, F.lit("]"),
            ).alias("box_coords"),
            F.max(F.col("l_discount") + 0.0).alias("sam_score"),
        )
        return strip.join(self.images.select("image_id", "image_name"), "image_id")

    @cached_property
    def raw_runs(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("image_id"),
            (F.col("l_linenumber") % 2).cast("int").alias("strip_id"),
            (F.col("l_partkey") % 50).cast("int").alias("y"),
            (F.col("l_suppkey") % 100).alias("x_start"),
            (F.col("l_suppkey") % 100 + F.col("l_quantity").cast("bigint") - 1).alias("x_end"),
        )

    @cached_property
    def strip_runs(self) -> DataFrame:
        return merge_runs(self.raw_runs, ["image_id", "strip_id"])

    @cached_property
    def leaf_runs(self) -> DataFrame:
        return merge_runs(self.raw_runs, ["image_id"])

    @cached_property
    def frames(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("image_id"),
            F.lit(FRAME_WIDTH).alias("width"),
            F.lit(FRAME_HEIGHT).alias("height"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """Detected components with their shape features."""
        w, h = (F.col("l_quantity") * 20).cast("int"), F.col("l_linenumber") * 30
        area = F.floor("l_extendedprice").cast("bigint")
        y = (F.col("l_partkey") % 1000).cast("int")
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("image_id"),
            F.col("l_suppkey").cast("int").alias("x"),
            y.alias("y"),
            w.alias("w"),
            h.alias("h"),
            area.alias("area"),
            (w / h).alias("aspect_ratio"),
            (area / (w * h)).alias("extent"),
            (y + h / 2).alias("centroid_y"),
            F.lit(DETECTION_HEIGHT).alias("image_height"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        """Box counts per image; empty low-priority images failed to decode."""
        counts = self.read("lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count(F.lit(1)).alias("_n"))
        priority = self.read("orders").select(F.col("o_orderkey").alias("image_id"), "o_orderpriority")
        n = F.when(F.col("_n").isNull() & (F.col("o_orderpriority") == "5-LOW"), -1).otherwise(F.coalesce("_n", F.lit(0)))
        return (
            self.images.join(priority, "image_id")
            .join(counts, "image_id", "left")
            .select(
                "image_id",
                "image_path",
                F.concat(F.lit("device"), F.col("device")).alias("subdirectory"),
                "image_name",
                n.cast("int").alias("num_boxes_detected"),
            )
        )

    @cached_property
    def redetections(self) -> DataFrame:
        """Second detection pass: unreadable for seven boxes, timed out for heavy images."""
        again = self.read("lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(
            F.count_distinct("l_linenumber").alias("_n"), F.sum("l_quantity").alias("_q")
        )
        return again.join(self.images.select("image_id", "image_path"), "image_id").select(
            "image_path",
            F.when(F.col("_n") < 7, F.col("_n")).cast("int").alias("new_num_boxes"),
            F.when(F.col("_q") > 250, "timeout").alias("error"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("image_id"),
            (F.col("l_partkey") % 50).cast("int").alias("y"),
            ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % FRAME_WIDTH).cast("int").alias("x"),
            (F.col("l_partkey") % 256).cast("int").alias("r"),
            (F.col("l_suppkey") * 7 % 256).cast("int").alias("g"),
            (F.col("l_orderkey") % 256).cast("int").alias("b"),
            (F.col("l_returnflag") != "R").alias("in_mask"),
        )

    @cached_property
    def patches(self) -> DataFrame:
        """24 measured patches per image: an affine mix of the reference plus a small step."""
        reference = F.array(
            *[
                F.struct(F.lit(i).alias("p"), F.lit(float(r)).alias("r"), F.lit(float(g)).alias("g"), F.lit(float(b)).alias("b"))
                for i, (r, g, b) in enumerate(REFERENCE_PATCHES)
            ]
        )
        step = ((F.col("s.p") * 7 + F.col("image_id")) % 5).cast("double")
        tint = (F.col("image_id") % 7).cast("double")
        return (
            self.read("orders")
            .select(F.col("o_orderkey").alias("image_id"))
            .repartition(SPREAD, "image_id")
            .select("image_id", F.explode(reference).alias("s"))
            .select(
                "image_id",
                F.col("s.p").alias("patch_idx"),
                (F.col("s.r") * 0.75 + F.col("s.g") * 0.125 + tint + step).alias("r"),
                (F.col("s.g") * 0.875 + 4.0 + step * 2.0).alias("g"),
                (F.col("s.b") * 0.75 + F.col("s.r") * 0.0625 + tint * 2.0 + 3.0).alias("b"),
            )
        )

    @cached_property
    def recon_pixels(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("image_id"),
            (F.col("l_linenumber") % 3).cast("int").alias("channel"),
            (F.col("l_tax") + 0.0).alias("target"),
            (F.col("l_discount") + 0.0).alias("recon"),
            (F.col("l_returnflag") != "R").alias("in_mask"),
        )

    @cached_property
    def recon_metrics(self) -> DataFrame:
        from phenoweave.operators.reconstruction import image_metrics

        return image_metrics(self.recon_pixels).filter("mse is not null").join(
            self.image_genotypes.select("image_id", "genotype", "device"), "image_id"
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("image_id"),
            F.concat(F.lit("g"), F.col("label")).alias("genotype"),
            (F.col("vec_id") % 8).cast("int").alias("device"),
            "embedding",
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """Given cluster labels, noise included."""
        return self.read("embeddings").select(
            F.col("vec_id").alias("image_id"),
            F.concat(F.lit("g"), F.col("label")).alias("genotype"),
            (F.col("vec_id") % 6 - 1).cast("int").alias("cluster"),
        )

    @cached_property
    def training_log(self) -> DataFrame:
        """One run per user, one epoch per day with events; losses from whole cents."""
        cents = F.round(F.col("value") * 100).cast("bigint")
        kept = F.col("event_type") != "error"
        mean = lambda total, n: F.try_divide(total.cast("double"), n * F.lit(100.0))
        return (
            self.read("events")
            .groupBy(F.col("user_id").alias("run_id"), F.dayofmonth("ts").alias("epoch"))
            .agg(
                mean(F.sum(F.when(kept, cents)), F.count_if(kept)).alias("train_loss"),
                mean(F.sum(cents), F.count(F.lit(1))).alias("val_loss"),
            )
        )
