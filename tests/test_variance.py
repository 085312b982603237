import numpy as np
import pandas as pd
import pytest

from phenoweave.operators import variance


def test_simulated_components_are_recovered(spark):
    rng = np.random.default_rng(7)
    n = 6000
    pdf = pd.DataFrame({"a": rng.integers(0, 800, n), "b": rng.integers(0, 200, n), "sam_score": rng.random(n)})
    pdf["y"] = (
        10 + rng.normal(0, np.sqrt(3), 800)[pdf.a] + rng.normal(0, 1, 200)[pdf.b] + rng.normal(0, 2, n)
    )
    got = variance.variance_partition(spark.createDataFrame(pdf), ["y"], ["a", "b"]).toPandas().set_index("component")
    assert got.variance["a"] == pytest.approx(3, rel=0.15)
    assert got.variance["b"] == pytest.approx(1, rel=0.3)
    assert got.variance["Residual"] == pytest.approx(4, rel=0.1)
    assert got.percent.sum() == pytest.approx(100)


def test_balanced_one_way_equals_anova(spark):
    rng = np.random.default_rng(3)
    groups, size = 30, 8
    y = rng.normal(0, 2, groups)[:, None] + rng.normal(0, 1, (groups, size))
    pdf = pd.DataFrame({"g": np.repeat(np.arange(groups), size), "y": y.ravel()})
    got = variance.variance_partition(spark.createDataFrame(pdf), ["y"], ["g"], score=None).toPandas().set_index("component")
    within = y.var(axis=1, ddof=1).mean()
    between = size * y.mean(axis=1).var(ddof=1)
    assert got.variance["Residual"] == pytest.approx(within)
    assert got.variance["g"] == pytest.approx((between - within) / size)


def test_forms_equal_the_matrix_definition(spark):
    """A_ij = tr(M Z_i Z_i' M Z_j Z_j') with M the centring matrix, missing values included."""
    rng = np.random.default_rng(5)
    n = 60
    pdf = pd.DataFrame({"a": rng.integers(0, 6, n).astype(float), "b": rng.integers(0, 4, n), "y": rng.normal(size=n), "z": rng.normal(size=n)})
    pdf.loc[:4, "a"] = None
    pdf.loc[10:14, "z"] = None
    clean = pdf.dropna(subset=["a"])
    forms = variance.quadratic_forms(
        spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b long, y double, z double"), ["y", "z"], ["a", "b"], score=None
    ).toPandas()
    for phenotype in ("y", "z"):
        rows = clean.dropna(subset=[phenotype])
        m = np.eye(len(rows)) - 1 / len(rows)
        kernels = [np.eye(len(rows))] + [(rows[f].to_numpy()[:, None] == rows[f].to_numpy()[None]).astype(float) for f in ("a", "b")]
        v = m @ rows[phenotype].to_numpy()
        got = forms[forms.phenotype == phenotype].set_index(["i", "j"]).value
        for i, ki in enumerate(kernels):
            assert got[(i, -1)] == pytest.approx(v @ ki @ v)
            for j, kj in enumerate(kernels):
                assert got[(i, j)] == pytest.approx(np.trace(m @ ki @ m @ kj))


def test_factors_like_the_residual_are_refused(spark):
    pdf = pd.DataFrame({"sam_score": np.arange(100) / 1e4, "y": np.arange(100.0)})
    with pytest.raises(Exception, match="one level per row"):
        variance.variance_partition(spark.createDataFrame(pdf), ["y"], ["sam_score"], score=None).collect()
    twin = pd.DataFrame({"a": np.arange(100) % 7, "b": np.arange(100) % 7, "y": np.arange(100.0) % 13})
    with pytest.raises(Exception, match="confounded"):
        variance.variance_partition(spark.createDataFrame(twin), ["y"], ["a", "b"]).collect()
