"""Leakage-free group splits and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoweave.operators.ordering import positions, running

TRAIN_RATIO = 0.70
VAL_RATIO = 0.15
SEED = 42


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("images"))


def size_buckets(df: DataFrame, group: str) -> DataFrame:
    """How many groups have 1, 2, 3-10 and more than 10 rows."""
    n = F.col("images")
    return group_sizes(df, group).agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(n == 1).cast("bigint").alias("one"),
        F.count_if(n == 2).cast("bigint").alias("two"),
        F.count_if(n.between(3, 10)).cast("bigint").alias("three_to_ten"),
        F.count_if(n > 10).cast("bigint").alias("over_ten"),
    )


def seeded_order(group: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(group).cast("string")))


def assign_groups(
    df: DataFrame,
    group: str,
    train: float = TRAIN_RATIO,
    val: float = VAL_RATIO,
    seed: int = SEED,
    min_rows: int = 3,
) -> DataFrame:
    """(group, images, split): one split per group.

    Groups below ``min_rows`` train; the rest are ranked by a seeded hash and
    cut at the floored ratios, the remainder being the test split. The rank is
    a parallel running count, so the number of groups is not limited.
    """
    sized = group_sizes(df, group).withColumn("_order", seeded_order(group, seed))
    large = (F.col("images") >= min_rows).cast("bigint")
    ranked = running(
        sized,
        [],
        ["_order", group],
        {"_rank": ("sum", large)},
        inclusive=False,
        totals={"_n": ("sum", large)},
    )
    n_train = F.floor(F.col("_n") * train)
    n_val = F.floor(F.col("_n") * val)
    split = (
        F.when((F.col("images") < min_rows) | (F.col("_rank") < n_train), "train")
        .when(F.col("_rank") < n_train + n_val, "val")
        .otherwise("test")
    )
    return ranked.select(group, "images", split.alias("split"))


def split_rows(df: DataFrame, assigned: DataFrame, group: str) -> DataFrame:
    return df.join(assigned.select(group, "split"), group)


def split_summary(df: DataFrame, group: str) -> DataFrame:
    """Rows, share, groups and rows per group by split, with a TOTAL row."""
    counted = df.rollup("split").agg(
        F.count(F.lit(1)).alias("images"), F.count_distinct(group).alias("groups")
    )
    # A handful of rows: one per split plus the total.
    every = Window.partitionBy(F.lit(0))
    return counted.select(
        F.coalesce("split", F.lit("TOTAL")).alias("split"),
        "images",
        (F.col("images") * 100.0 / F.max("images").over(every)).alias("percent"),
        "groups",
        (F.col("images") / F.col("groups")).alias("images_per_group"),
    )


def leaking_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups found in more than one split; empty for a sound assignment."""
    return (
        df.groupBy(group)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter("first_split <> last_split")
    )


def group_lists(assigned: DataFrame, group: str) -> DataFrame:
    """(split, group, position): the sorted distinct groups of each split."""
    distinct = assigned.select("split", group).distinct()
    return positions(distinct, ["split"], [group])
