"""Variance partition over crossed random factors by MINQUE(0).

Quadratic forms of the data and their expectations are grouped sums and
pairwise count tables; only a (k+1) x (k+1) system per phenotype is solved.
Estimates are unbiased but not those of an iterative REML fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from phenoweave.session import durable

RESIDUAL = "Residual"


def _complete(df: DataFrame, factors: Sequence[str], score: str | None, digits: int) -> DataFrame:
    levels = [
        (F.round(F.col(f), digits) if f == score else F.col(f)).cast("string").alias(f"_f_{f}") for f in factors
    ]
    return df.select("*", *levels).dropna(subset=[f"_f_{f}" for f in factors])


def quadratic_forms(
    df: DataFrame, phenotypes: Sequence[str], factors: Sequence[str], score: str | None = "sam_score",
    score_digits: int = 2,
) -> DataFrame:
    """(phenotype, i, j, value): matrix A for j >= 0 and the forms q at j = -1.

    Index 0 is the residual, 1..k the factors. Rows with a missing factor are
    left out; a missing phenotype only leaves out its own row.
    """
    # Three aggregations follow; the narrow input is computed once and written.
    base = durable(
        _complete(df, factors, score, score_digits).select(*phenotypes, *[f"_f_{f}" for f in factors]),
        "variance-input",
    )
    index = {f: i + 1 for i, f in enumerate(factors)}
    stack = lambda frame, make: frame.select(
        "*", F.explode(F.array(*[make(k, p) for k, p in enumerate(phenotypes)])).alias("_p")
    )

    # Whole-table moments per phenotype: one row, one column set per phenotype.
    moments = base.agg(
        *[F.count(p).cast("double").alias(f"n{k}") for k, p in enumerate(phenotypes)],
        *[F.avg(p).alias(f"m{k}") for k, p in enumerate(phenotypes)],
        *[F.var_pop(p).alias(f"v{k}") for k, p in enumerate(phenotypes)],
    )
    whole = stack(
        moments,
        lambda k, p: F.struct(
            F.lit(p).alias("phenotype"), F.col(f"n{k}").alias("n"), F.col(f"m{k}").alias("mean"),
            F.col(f"v{k}").alias("var"),
        ),
    ).select("_p.*")

    # Level table: every factor in one pass over the rows.
    levels = (
        base.select(
            F.explode(
                F.array(*[F.struct(F.lit(index[f]).alias("i"), F.col(f"_f_{f}").alias("level")) for f in factors])
            ).alias("f"),
            *phenotypes,
        )
        .groupBy("f.i", "f.level")
        .agg(
            *[F.count(p).cast("double").alias(f"n{k}") for k, p in enumerate(phenotypes)],
            *[F.sum(p).cast("double").alias(f"s{k}") for k, p in enumerate(phenotypes)],
        )
    )
    level_rows = (
        stack(levels, lambda k, p: F.struct(F.lit(p).alias("phenotype"), F.col(f"n{k}").alias("n_a"), F.col(f"s{k}").alias("s_a")))
        .select("i", "level", "_p.*")
        .filter("n_a > 0")
    )
    factor_sums = (
        level_rows.join(whole, "phenotype")
        .groupBy("phenotype", "i")
        .agg(
            F.sum(F.pow(F.col("s_a") - F.col("n_a") * F.col("mean"), F.lit(2.0))).alias("q"),
            F.sum(F.col("n_a") * F.col("n_a")).alias("n2"),
            F.sum(F.col("n_a") * F.col("n_a") * F.col("n_a")).alias("n3"),
            F.max("n").alias("n"),
            F.count(F.lit(1)).alias("levels"),
        )
    )

    cell = lambda i, j, value: F.struct(
        F.lit(i).cast("int").alias("i") if isinstance(i, int) else i.cast("int").alias("i"),
        F.lit(j).cast("int").alias("j") if isinstance(j, int) else j.cast("int").alias("j"),
        value.cast("double").alias("value"),
    )
    n = F.col("n")
    from_whole = whole.select(
        "phenotype", F.explode(F.array(cell(0, -1, n * F.col("var")), cell(0, 0, n - 1))).alias("c")
    )
    off = n - F.col("n2") / n
    from_factors = factor_sums.select(
        "phenotype",
        F.explode(
            F.array(
                cell(F.col("i"), -1, F.col("q")),
                cell(F.col("i"), F.col("i"), F.col("n2") - 2 * F.col("n3") / n + F.col("n2") * F.col("n2") / (n * n)),
                cell(F.col("i"), 0, off),
                cell(0, F.col("i"), off),
                # Level counts, kept for the singularity check: j = -2.
                cell(F.col("i"), -2, F.col("levels")),
            )
        ).alias("c"),
    )
    out = from_whole.unionByName(from_factors)
    if len(factors) > 1:
        pairs = (
            base.select(
                F.explode(
                    F.array(
                        *[
                            F.struct(
                                F.lit(index[a]).alias("i"), F.col(f"_f_{a}").alias("a"),
                                F.lit(index[b]).alias("j"), F.col(f"_f_{b}").alias("b"),
                            )
                            for a, b in combinations(factors, 2)
                        ]
                    )
                ).alias("f"),
                *phenotypes,
            )
            .groupBy("f.i", "f.a", "f.j", "f.b")
            .agg(*[F.count(p).cast("double").alias(f"n{k}") for k, p in enumerate(phenotypes)])
        )
        pair_rows = (
            stack(pairs, lambda k, p: F.struct(F.lit(p).alias("phenotype"), F.col(f"n{k}").alias("n_ab")))
            .select("i", "a", "j", "b", "_p.*")
            .filter("n_ab > 0")
        )
        side = lambda i, level, name: level_rows.select(
            "phenotype", F.col("i").alias(i), F.col("level").alias(level), F.col("n_a").alias(name)
        )
        pair_sums = (
            pair_rows.join(side("i", "a", "n_i"), ["phenotype", "i", "a"])
            .join(side("j", "b", "n_j"), ["phenotype", "j", "b"])
            .groupBy("phenotype", "i", "j")
            .agg(
                F.sum(F.col("n_ab") * F.col("n_ab")).alias("ab2"),
                F.sum(F.col("n_ab") * F.col("n_i") * F.col("n_j")).alias("ab3"),
            )
        )
        totals = factor_sums.select("phenotype", "i", "n", "n2")
        value = (
            F.col("ab2") - 2 * F.col("ab3") / n + F.col("n2") * F.col("n2_j") / (n * n)
        )
        from_pairs = (
            pair_sums.join(totals, ["phenotype", "i"])
            .join(totals.select("phenotype", F.col("i").alias("j"), F.col("n2").alias("n2_j")), ["phenotype", "j"])
            .select(
                "phenotype",
                F.explode(F.array(cell(F.col("i"), F.col("j"), value), cell(F.col("j"), F.col("i"), value))).alias("c"),
            )
        )
        out = out.unionByName(from_pairs)
    return out.select("phenotype", "c.i", "c.j", "c.value")


def variance_partition(
    df: DataFrame, phenotypes: Sequence[str], factors: Sequence[str], score: str | None = "sam_score",
    score_digits: int = 2, max_level_share: float = 0.9, max_condition: float = 1e10,
) -> DataFrame:
    """(phenotype, component, variance, percent), negatives clipped at zero.

    Fails when a factor has nearly as many levels as rows, or when the system
    is close to singular, as such factors cannot be told from the residual.
    """
    names = [RESIDUAL, *factors]
    size = len(names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, q = np.zeros((size, size)), np.zeros(size)
        for i, j, value in zip(pdf["i"], pdf["j"], pdf["value"]):
            if j >= 0:
                a[i, j] = value
            elif j == -1:
                q[i] = value
            elif value > max_level_share * (pdf.loc[(pdf.i == 0) & (pdf.j == 0), "value"].iloc[0] + 1):
                raise ValueError(f"factor {names[i]} has almost one level per row")
        if np.linalg.cond(a) > max_condition:
            raise ValueError("factors are confounded: the variance system is singular")
        variance = np.clip(np.linalg.solve(a, q), 0.0, None)
        total = variance.sum()
        return pd.DataFrame(
            {
                "phenotype": pdf["phenotype"].iloc[0],
                "component": names,
                "variance": variance,
                "percent": 100 * variance / total if total > 0 else np.full(size, np.nan),
            }
        )

    # One group per phenotype: (k+1)(k+3) rows at most.
    return quadratic_forms(df, phenotypes, factors, score, score_digits).groupBy("phenotype").applyInPandas(
        solve, "phenotype string, component string, variance double, percent double"
    )


def without_residual(partition: DataFrame) -> DataFrame:
    return partition.filter(F.col("component") != RESIDUAL)
