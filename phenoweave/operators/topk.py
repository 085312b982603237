"""Category counts, top-k, sampling and distribution numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from phenoweave.operators.ordering import positions, quantiles
from phenoweave.session import durable


def value_counts(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("images"))


def most_common(df: DataFrame, category: str, k: int) -> DataFrame:
    """The k most frequent categories; ties by the category itself."""
    return value_counts(df, category).orderBy(F.desc("images"), F.asc(category)).limit(k)


def top_k_per_group(counts: DataFrame, group: Sequence[str], measure: str, tie: str, k: int) -> DataFrame:
    """Rows ranked 1..k per group; Spark limits each task to k rows per group before the shuffle."""
    spec = Window.partitionBy(*group).orderBy(F.desc(measure), F.asc(tie))
    return counts.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= k)


def restrict_to_most_common(df: DataFrame, category: str, k: int) -> DataFrame:
    return df.join(most_common(df, category, k).select(category), category, "left_semi")


def outside_most_common(df: DataFrame, category: str, k: int) -> DataFrame:
    return df.join(most_common(df, category, k).select(category), category, "left_anti")


def bucket_other(df: DataFrame, category: str, k: int, name: str = "bucket", other: str = "Other") -> DataFrame:
    """Add ``name``: the category as text when among the k most common, else ``other``."""
    top = most_common(df, category, k).select(category, F.lit(True).alias("_top"))
    return (
        df.join(top, category, "left")
        .withColumn(name, F.when(F.col("_top"), F.col(category).cast("string")).otherwise(other))
        .drop("_top")
    )


def distinct_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*by).agg(*[count(c).alias(f"distinct_{c}") for c in columns])


def evenly_spaced(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Every ``max(1, N div n)``-th row in order, the first n of them."""
    ranked = positions(df, [], list(order), "_pos", "_n")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_n") / n))
    return ranked.filter((F.col("_pos") % step == 0) & (F.col("_pos") < step * n)).select(*df.columns)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42, hashing: str = "xxhash64") -> DataFrame:
    """n rows without replacement, the same rows for the same seed and data."""
    if hashing == "md5":
        draw = F.md5(F.concat(F.lit(f"{seed}"), F.col(key).cast("string")))
    else:
        draw = F.xxhash64(F.col(key), F.lit(seed))
    return df.withColumn("_draw", draw).orderBy("_draw", key).limit(n).drop("_draw")


def best_and_worst(df: DataFrame, measure: str, tie: str, k: int = 4) -> DataFrame:
    """The k lowest rows (``best``) and the k highest (``worst``), two bounded sorts."""
    best = df.orderBy(F.asc(measure), F.asc(tie)).limit(k).withColumn("side", F.lit("best"))
    worst = df.orderBy(F.desc(measure), F.desc(tie)).limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram with a closed last bin; empty bins are kept."""
    bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s"))
    width = (F.col("_b")["hi"] - F.col("_b")["lo"]) / bins
    binned = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_b", bounds.scalar())
        .select(
            F.when(F.col("_b")["hi"] == F.col("_b")["lo"], bins // 2)
            .otherwise(
                F.least(F.floor(F.try_divide(F.col(value) - F.col("_b")["lo"], width)), F.lit(bins - 1))
            )
            .cast("int")
            .alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    flat = F.col("_b")["hi"] == F.col("_b")["lo"]
    low = F.when(flat, F.col("_b")["lo"] - 0.5).otherwise(F.col("_b")["lo"])
    size = F.when(flat, F.lit(1.0 / bins)).otherwise(width)
    return (
        every.join(binned, "bin", "left")
        .withColumn("_b", bounds.scalar())
        .select(
            "bin",
            (low + size * F.col("bin")).alias("left_edge"),
            (low + size * (F.col("bin") + 1)).alias("right_edge"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        )
    )


def box_plot_numbers(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers per group, exact, without gathering a group."""
    # One row per group; the next scan of the rows takes it along.
    quartiles = durable(quantiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), "quartiles")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = lambda keep: F.when(keep, F.col(value))
    whiskers = (
        df.filter(F.col(value).isNotNull())
        .join(quartiles, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(inside(F.col(value) >= F.col("q1") - reach)).alias("low_whisker"),
            F.max(inside(F.col(value) <= F.col("q3") + reach)).alias("high_whisker"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return whiskers.select(
        group,
        "n",
        F.least("low_whisker", "q1").alias("low_whisker"),
        "q1",
        "median",
        "q3",
        F.greatest("high_whisker", "q3").alias("high_whisker"),
    )
