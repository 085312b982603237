import numpy as np
import pandas as pd
import pytest

from phenoweave.operators import reml


def crossed(seed, n=240):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.integers(0, 40, n), "row": rng.integers(0, 7, n), "dev": rng.integers(0, 4, n)})
    y = 50 + rng.normal(0, 1.5, 40)[pdf.g] + rng.normal(0, 2, 7)[pdf.row] + rng.normal(0, 1, 4)[pdf.dev] + rng.normal(0, 1.2, n)
    return pdf.assign(y=y, z=1000 * y**2, flat=rng.normal(0, 1, n))


def dense(pdf, y, factors, variance):
    """Restricted likelihood equations by the whole covariance: y'P Vi P y - tr(P Vi), over the latter."""
    n = len(pdf)
    kernels = [(pdf[f].to_numpy()[:, None] == pdf[f].to_numpy()[None]).astype(float) for f in factors]
    v = variance[reml.RESIDUAL] * np.eye(n) + sum(variance[f] * k for f, k in zip(factors, kernels))
    inverse = np.linalg.inv(v)
    one = inverse.sum(1)
    p = inverse - np.outer(one, one) / one.sum()
    py = p @ (y - y.mean())
    out = {}
    for name, k in zip((reml.RESIDUAL, *factors), (np.eye(n), *kernels)):
        out[name] = (py @ k @ py - np.trace(p @ k)) / np.trace(p @ k)
    return out


def test_estimates_solve_the_likelihood_equations(spark):
    factors = ["g", "row", "dev"]
    pdf = crossed(4)
    pdf.loc[3:20, "z"] = np.nan
    got = reml.reml_partition(spark.createDataFrame(pdf), ["y", "z", "flat"], factors, score=None).toPandas()
    for name in ("y", "z", "flat"):
        rows = pdf.dropna(subset=[name])
        variance = got[got.phenotype == name].set_index("component").variance.to_dict()
        gaps = dense(rows, rows[name].to_numpy(), factors, variance)
        for component, gap in gaps.items():
            # A component at zero has nothing to gain from more variance.
            assert abs(gap) < 1e-6 or variance[component] < 1e-6 * variance[reml.RESIDUAL] and gap < 0, (name, component, gap)
        assert got[got.phenotype == name].percent.sum() == pytest.approx(100)


def test_scans_of_a_table_equal_those_here(spark, monkeypatch):
    data = spark.createDataFrame(crossed(7))
    here = reml.reml_partition(data, ["y"], ["g", "row", "dev"], score=None).toPandas()
    monkeypatch.setattr(reml, "LEVELS_HERE", 0)
    there = reml.reml_partition(data, ["y"], ["g", "row", "dev"], score=None).toPandas()
    assert here.variance.tolist() == pytest.approx(there.variance.tolist(), rel=1e-9)


def test_balanced_one_way_equals_anova(spark):
    rng = np.random.default_rng(3)
    groups, size = 30, 8
    y = rng.normal(0, 2, groups)[:, None] + rng.normal(0, 1, (groups, size))
    pdf = pd.DataFrame({"g": np.repeat(np.arange(groups), size), "y": y.ravel()})
    got = reml.reml_partition(spark.createDataFrame(pdf), ["y"], ["g"], score=None).toPandas().set_index("component")
    within = y.var(axis=1, ddof=1).mean()
    assert got.variance["Residual"] == pytest.approx(within, rel=1e-6)
    assert got.variance["g"] == pytest.approx((size * y.mean(axis=1).var(ddof=1) - within) / size, rel=1e-6)


def test_too_many_small_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(reml, "MOST_LEVELS", 5)
    with pytest.raises(ValueError, match="more than 5 levels"):
        reml.reml_partition(spark.createDataFrame(crossed(1)), ["y"], ["g", "row", "dev"], score=None)
