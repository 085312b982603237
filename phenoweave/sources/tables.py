"""CSV, TSV, JSON and Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave import schemas


def _csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.options(header=True, enforceSchema=False, **options).schema(schema).csv(path)


def read_field_map(spark: SparkSession, path: str) -> DataFrame:
    """(plot, genotype, row, range); header names may carry blanks."""
    raw = spark.read.options(header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    types = {"plot": "int", "genotype": "string", "row": "int", "range": "int"}
    return trimmed.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items() if c in trimmed.columns])


def read_measurements(spark: SparkSession, path: str, with_subdirectory: bool = False) -> DataFrame:
    return _csv(spark, path, schemas.ALL_MEASUREMENTS if with_subdirectory else schemas.MEASUREMENTS, escape='"')


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated panel; the second column is the name."""
    return spark.read.option("sep", "\t").schema(schemas.FAM).csv(path)


def read_genotype_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias("vcf_name"))


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.SKIPPED)


def read_genotype_splits(spark: SparkSession, path: str) -> DataFrame:
    """(genotype, split) rows of the nested split document."""
    document = spark.read.schema(schemas.GENOTYPE_SPLITS).json(path, multiLine=True)
    parts = [
        document.select(F.explode(f"{s}_genotypes").alias("genotype"), F.lit(s).alias("split"))
        for s in ("train", "val", "test")
    ]
    return reduce(DataFrame.unionByName, parts)


def read_image_splits(spark: SparkSession, path: str) -> DataFrame:
    """Flat image rows of the nested document {"train": [...], "val": [...], "test": [...]}."""
    image = "STRUCT<device: INT, plot: INT, filename: STRING, genotype: STRING, image_path: STRING, mask_dir: STRING, mask0_path: STRING, mask1_path: STRING>"
    document = spark.read.schema(", ".join(f"{s} ARRAY<{image}>" for s in ("train", "val", "test"))).json(path, multiLine=True)
    parts = [document.select(F.inline(s)).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return reduce(DataFrame.unionByName, parts)


def read_training_log(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    log = _csv(spark, path, schemas.TRAINING_LOG)
    return log if run_id is None else log.select(F.lit(run_id).alias("run_id"), "*")


def read_training_history(spark: SparkSession, path: str) -> DataFrame:
    """Per-epoch rows: epoch, the loss parts of both phases, and the run's totals."""
    document = spark.read.schema(schemas.TRAINING_HISTORY).json(path, multiLine=True)
    pairs = document.select(
        F.posexplode(F.arrays_zip("train_losses", "val_losses")).alias("_i", "_pair"),
        "best_val_loss",
        "total_epochs",
        "training_time_hours",
    )
    parts = ("total_loss", "reconstruction_loss", "l1_loss", "mean_weight")
    return pairs.select(
        (F.col("_i") + 1).alias("epoch"),
        *[F.col(f"_pair.{side}_losses.{p}").alias(f"{side}_{p}") for side in ("train", "val") for p in parts],
        "best_val_loss",
        "total_epochs",
        "training_time_hours",
    )


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Parquet embeddings with an array column."""
    return spark.read.parquet(path)


def read_wide_embeddings(spark: SparkSession, path: str, dimension: int = 256) -> DataFrame:
    """CSV with one column per dimension -> metadata columns and an array."""
    columns = [f"emb_{i}" for i in range(dimension)]
    wide = _csv(spark, path, schemas.EMBEDDING_META + "".join(f", {c} FLOAT" for c in columns))
    return wide.select(
        *[c for c in wide.columns if c not in columns], F.array(*columns).alias("embedding")
    )


def read_lab_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row: mean_L, mean_a, mean_b, std_L, std_a, std_b."""
    document = spark.read.schema(schemas.LAB_STATISTICS).json(path, multiLine=True)
    return document.select(
        *[F.col(f"lab_{n}")[i].alias(f"{n}_{c}") for n in ("mean", "std") for i, c in enumerate(("L", "a", "b"))]
    )
