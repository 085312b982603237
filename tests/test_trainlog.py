import numpy as np
import pandas as pd
import pytest

from phenoweave.operators import ordering, trainlog

RNG = np.random.default_rng(11)


def series(n, kind):
    if kind == "noisy":
        return 5 + RNG.random(n)
    if kind == "falling":
        return np.linspace(4, 3, n) + RNG.normal(0, 0.01, n)
    return np.round(3 + RNG.random(n), 1)  # many ties


@pytest.fixture(scope="module")
def logs():
    rows = []
    for run, (n, kind) in enumerate([(1, "noisy"), (40, "noisy"), (160, "falling"), (90, "ties"), (9, "noisy"), (300, "ties")]):
        kept = np.sort(RNG.choice(np.arange(1, 2 * n + 1), n, replace=False))
        for e, v in zip(kept, series(n, kind)):
            rows.append((run, int(e), float(v) - 0.1, float(v)))
    return pd.DataFrame(rows, columns=["run_id", "epoch", "train_loss", "val_loss"])


@pytest.fixture(scope="module")
def frame(spark, logs):
    return spark.createDataFrame(logs, "run_id int, epoch int, train_loss double, val_loss double").repartition(5)


@pytest.fixture(params=[40, None])
def parts(request, monkeypatch):
    """Many parts force the split path on short runs as well."""
    monkeypatch.setattr(ordering.aligned, "__defaults__", (request.param,))
    monkeypatch.setattr(ordering.positions, "__defaults__", ("position", None, request.param))
    return request.param


def sequential_stop(values, patience, delta, mode):
    best, counter, out = None, 0, []
    for v in values:
        better = best is None or (v < best - delta if mode == "min" else v > best + delta)
        best, counter = (v, 0) if better else (best, counter + 1)
        out.append((better, counter))
    return out


@pytest.mark.parametrize("delta,mode", [(0.0, "min"), (0.0, "max"), (0.07, "min"), (0.07, "max")])
def test_improvements_follow_the_sequential_rule(frame, logs, parts, delta, mode):
    got = trainlog.with_improvements(frame, mode=mode, min_delta=delta).toPandas().sort_values(["run_id", "epoch"])
    for run, pdf in logs.groupby("run_id"):
        want = sequential_stop(pdf.val_loss, 5, delta, mode)
        mine = got[got.run_id == run]
        assert list(zip(mine.improved, mine.stalled)) == want


def test_early_stopping(frame, logs):
    got = trainlog.early_stopping(frame, patience=6).toPandas().set_index("run_id")
    for run, pdf in logs.groupby("run_id"):
        states = sequential_stop(pdf.val_loss, 6, 0.0, "min")
        stop = next((e for e, (_, c) in zip(pdf.epoch, states) if c >= 6), None)
        seen = pdf if stop is None else pdf[pdf.epoch <= stop]
        assert (np.isnan(got.stop_epoch[run]) and stop is None) or got.stop_epoch[run] == stop
        assert got.best_value[run] == seen.val_loss.min()


def sequential_rate(values, patience, threshold, initial=1e-4, factor=0.5, minimum=1e-6):
    rate, best, bad, out = initial, float("inf"), 0, []
    for v in values:
        out.append(rate)
        best, bad = (v, 0) if v < best * (1 - threshold) else (best, bad + 1)
        if bad > patience:
            rate, bad = max(rate * factor, minimum), 0
    return out


@pytest.mark.parametrize("patience,threshold", [(5, 1e-4), (2, 0.02), (0, 1e-4)])
def test_learning_rate_replay(frame, logs, parts, patience, threshold):
    got = trainlog.plateau_learning_rate(frame, patience=patience, threshold=threshold).toPandas()
    got = got.sort_values(["run_id", "epoch"])
    for run, pdf in logs.groupby("run_id"):
        assert got[got.run_id == run].replayed_rate.tolist() == pytest.approx(sequential_rate(pdf.val_loss, patience, threshold))


def test_curves(frame, logs, parts):
    got = trainlog.curve_features(frame).toPandas().sort_values(["run_id", "epoch"])
    for run, pdf in logs.groupby("run_id"):
        mine, v = got[got.run_id == run], pdf.val_loss.to_numpy()
        steps = -np.diff(v)
        assert mine.improvement.to_numpy()[1:] == pytest.approx(steps)
        smooth = np.convolve(steps, np.ones(5) / 5, mode="valid") if len(steps) >= 5 else np.array([])
        assert mine.smoothed_improvement.dropna().to_numpy() == pytest.approx(smooth)
        rolling = [np.std(v[max(0, i - 10) : i + 1]) for i in range(len(v))] if len(v) >= 10 else []
        assert mine.rolling_std.dropna().tolist() == pytest.approx(rolling)
        assert mine.gap.to_numpy() == pytest.approx(0.1)


def test_a_relative_rule_rejects_negative_values(spark):
    df = spark.createDataFrame([(1, 1, -1.0), (1, 2, -2.0)], "run_id int, epoch int, val_loss double")
    with pytest.raises(Exception, match="zero or more"):
        trainlog.plateau_learning_rate(df).collect()
    with pytest.raises(ValueError):
        trainlog.with_improvements(df, mode="max", relative=0.1)


def test_published_log_golden(spark):
    """Learning-rate drops and stopping of the published 100-epoch run."""
    from golden_log import DROPS, VAL_LOSS

    log = spark.createDataFrame([("run", e, v, v) for e, v in enumerate(VAL_LOSS, 1)], "run_id string, epoch int, train_loss double, val_loss double")
    rates = trainlog.plateau_learning_rate(log).orderBy("epoch").collect()
    rate = 1e-4
    for row in rates:
        if row["epoch"] in DROPS:
            rate = max(rate / 2, 1e-6)
        assert row["replayed_rate"] == pytest.approx(rate)
    stop = trainlog.early_stopping(log).first()
    assert (stop["best_epoch"], stop["stop_epoch"]) == (100, None)
    facts = trainlog.run_facts(log).first()
    assert facts["best_epoch"] == 100 and facts["best_val_loss"] == pytest.approx(3.3188098, abs=1e-6)
