"""Small numeric Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def psnr(mse: Column) -> Column:
    """Peak signal-to-noise ratio in dB for a unit peak."""
    return 10 * F.log10(F.lit(1.0) / (mse + 1e-8))


def relative_improvement(first: Column, best: Column) -> Column:
    """Improvement in percent of the first value; null when that is zero."""
    return F.try_divide(first - best, first) * 100


def ratio_percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def expect_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bad-value counts per checked column (null, NaN or infinite)."""
    counts = df.agg(*[F.count_if(~is_finite(F.col(c).cast("double"))).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "bad_values")


def rescale_unit(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Min-max rescale of ``value`` to [0, 1] per key: aggregate, then join back."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return (
        df.join(span, list(keys))
        .withColumn(name, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8))
        .drop("_lo", "_hi")
    )


def vector_mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(v)


def vector_std(v: Column) -> Column:
    """Sample standard deviation of the entries of one vector."""
    total = F.aggregate(
        v,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct(
            (a["s"] + x.cast("double")).alias("s"),
            (a["q"] + x.cast("double") * x.cast("double")).alias("q"),
        ),
        lambda a: F.sqrt(
            F.greatest((a["q"] - a["s"] * a["s"] / F.size(v)) / F.nullif(F.size(v) - 1, F.lit(0)), F.lit(0.0))
        ),
    )
    return total


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with the norms' product bounded below by 1e-8."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return dot / F.greatest(vector_norm(a) * vector_norm(b), F.lit(1e-8))


def wide_to_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c) for c in columns])


def array_to_wide(vector: str, dimension: int, prefix: str = "emb_") -> list[Column]:
    return [F.col(vector)[i].alias(f"{prefix}{i}") for i in range(dimension)]
