"""Training-log analysis: curves, best epochs, early stopping, learning rates.

A log is (run_id, epoch, train_loss, val_loss, ...), one row per run and epoch.
Row frames and running values go through the ordered operators, so a run of
any length is analysed in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from phenoweave.functions.numeric import relative_improvement
from phenoweave.operators.ordering import aligned, framed, positions, scan
from phenoweave.session import durable

PATIENCE = 15
ROLLING_ROWS = 10


def curve_features(
    log: DataFrame, run: str = "run_id", order: str = "epoch", value: str = "val_loss", train: str = "train_loss",
    smooth: int = 5, rolling: int = ROLLING_ROWS,
) -> DataFrame:
    """Gap, fit flag, improvement, its centred moving average and the rolling deviation.

    ``improvement`` is the drop from the previous row. Its average over a full
    centred window telescopes to a difference of two rows. The deviation covers
    the row and up to ``rolling`` earlier ones, for runs of that many rows.
    """
    half = smooth // 2
    indexed = positions(log, [run], [order], "position", "epochs")
    out = framed(
        indexed,
        [run],
        "position",
        before=max(rolling, half + 1),
        after=half,
        columns={
            "improvement": lambda w: F.lag(value).over(w) - F.col(value),
            "smoothed_improvement": lambda w: (F.lag(value, half + 1).over(w) - F.lead(value, half).over(w)) / smooth,
            "_std": lambda w: F.stddev_pop(value).over(w.rowsBetween(-rolling, 0)),
        },
    )
    gap = F.col(value) - F.col(train)
    return out.select(
        *log.columns,
        gap.alias("gap"),
        F.when(gap > 0, "overfitting").when(gap <= 0, "underfitting").alias("fit"),
        "improvement",
        "smoothed_improvement",
        F.when(F.col("epochs") >= rolling, F.col("_std")).alias("rolling_std"),
    )


def last_epochs(log: DataFrame, n: int = 20, run: str = "run_id", order: str = "epoch") -> DataFrame:
    """The last n rows of each run; tasks keep n rows per run before the shuffle."""
    spec = Window.partitionBy(run).orderBy(F.desc(order))
    return log.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") <= n).drop("_rn")


def _accepted(records: DataFrame, run: str, order: str, value: str, min_delta: float, relative: float) -> DataFrame:
    """(run, order) of the records that beat the last accepted value by the margin.

    Sequential by definition, but only record lows can be accepted, so the
    other rows never get here. Rows stream through in order with one carried
    value per task.
    """
    types = {f.name: f.dataType.simpleString() for f in records.schema.fields}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, best = None, 0.0
        for pdf in batches:
            keep = []
            if relative and (pdf[value] < 0).any():
                raise ValueError("a relative threshold needs values of zero or more")
            for key, v in zip(pdf[run].tolist(), pdf[value].tolist()):
                if key != current or v < best * (1 - relative) - min_delta:
                    current, best = key, v
                    keep.append(True)
                else:
                    keep.append(False)
            yield pdf.loc[keep, [run, order]]

    return (
        records.select(run, order, value)
        .repartition(run)
        .sortWithinPartitions(run, order)
        .mapInPandas(fold, f"{run} {types[run]}, {order} {types[order]}")
    )


def _improvements(
    log: DataFrame, run: str, order: str, value: str, mode: str, min_delta: float, relative: float
) -> DataFrame:
    """:func:`with_improvements` over an aligned frame, for further scans."""
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be min or max, not {mode}")
    if relative and mode == "max":
        raise ValueError("a relative threshold applies to falling values")
    sign = 1.0 if mode == "min" else -1.0
    # Several scans follow: the rows are ordered once, and what a scan found is written for the next.
    base = aligned(log, [run], [order])
    seen = durable(
        scan(
            base.withColumn("_v", F.col(value) * sign),
            {"position": ("sum", F.lit(1).cast("bigint")), "best_before": ("min", F.col("_v"))},
            inclusive=False,
        ),
        "training-log",
    )
    record = F.col("best_before").isNull() | (F.col("_v") < F.col("best_before"))
    if min_delta or relative:
        accepted = _accepted(seen.filter(record), run, order, "_v", min_delta, relative)
        seen = seen.join(accepted.withColumn("_ok", F.lit(True)), [run, order], "left").withColumn(
            "improved", F.coalesce("_ok", F.lit(False))
        )
    else:
        seen = seen.withColumn("improved", record)
    marked = seen.select(
        *base.columns, "position", (F.col("best_before") * sign).alias("best_before"), "improved"
    )
    if min_delta or relative:
        marked = durable(marked, "training-log")
    last = scan(marked, {"_last": ("max", F.when(F.col("improved"), F.col("position")))})
    return last.withColumn("stalled", F.col("position") - F.col("_last")).drop("_last")


def with_improvements(
    log: DataFrame, run: str = "run_id", order: str = "epoch", value: str = "val_loss", mode: str = "min",
    min_delta: float = 0.0, relative: float = 0.0,
) -> DataFrame:
    """Add ``position``, ``best_before``, ``improved`` and ``stalled`` (rows since improving).

    Without a margin an improvement is a new record. With one it is found by a
    fold over the records only.
    """
    return _improvements(log, run, order, value, mode, min_delta, relative).drop("_key", "_part", "_at")


def early_stopping(
    log: DataFrame, patience: int = PATIENCE, run: str = "run_id", order: str = "epoch", value: str = "val_loss",
    mode: str = "min", min_delta: float = 0.0,
) -> DataFrame:
    """Per run: the epoch training stops at (null if it never does) and the best until then."""
    seen = with_improvements(log, run, order, value, mode, min_delta)
    stops = seen.groupBy(run).agg(
        F.min(F.when(F.col("stalled") >= patience, F.col(order))).alias("stop_epoch"),
        F.max(order).alias("_last_epoch"),
    )
    return (
        seen.filter("improved")
        .join(stops, run)
        .filter(F.col(order) <= F.coalesce("stop_epoch", "_last_epoch"))
        .groupBy(run)
        .agg(
            F.max(order).alias("best_epoch"),
            F.max_by(value, order).alias("best_value"),
            F.max("stop_epoch").alias("stop_epoch"),
        )
    )


def plateau_learning_rate(
    log: DataFrame, initial: float = 1e-4, factor: float = 0.5, patience: int = 5, threshold: float = 1e-4,
    minimum: float = 1e-6, run: str = "run_id", order: str = "epoch", value: str = "val_loss",
) -> DataFrame:
    """Replay a reduce-on-plateau schedule: the rate in force during each epoch.

    Within a stall every ``patience + 1``-th row cuts the rate, so the number of
    earlier cuts is a running sum and the rate a power of the factor.
    """
    seen = durable(_improvements(log, run, order, value, "min", 0.0, threshold), "training-log")
    cut = ((F.col("stalled") > 0) & (F.col("stalled") % (patience + 1) == 0)).cast("bigint")
    counted = scan(seen, {"_cuts": ("sum", cut)}, inclusive=False)
    rate = F.greatest(F.lit(initial) * F.pow(F.lit(factor), F.col("_cuts")), F.lit(minimum))
    return counted.select(*log.columns, rate.alias("replayed_rate"))


def run_facts(log: DataFrame, run: str = "run_id", order: str = "epoch", hours: str | None = None) -> DataFrame:
    """Best and final values, gaps, improvement and time per epoch of each run."""
    rank = F.struct(F.col("val_loss"), F.col(order))
    facts = log.groupBy(run).agg(
        F.count(F.lit(1)).alias("epochs"),
        F.min(rank)[order].alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.min_by("train_loss", rank).alias("train_at_best"),
        F.min_by("val_loss", order).alias("first_val_loss"),
        F.max_by("train_loss", order).alias("final_train_loss"),
        F.max_by("val_loss", order).alias("final_val_loss"),
        *([F.max(hours).alias("_hours")] if hours else []),
    )
    out = facts.select(
        run, "epochs", "best_epoch", "best_val_loss", "final_train_loss", "final_val_loss",
        (F.col("best_val_loss") - F.col("train_at_best")).alias("gap_at_best"),
        (F.col("final_val_loss") - F.col("final_train_loss")).alias("final_gap"),
        relative_improvement(F.col("first_val_loss"), F.col("best_val_loss")).alias("improvement_percent"),
        *([(F.col("_hours") * 60 / F.col("epochs")).alias("minutes_per_epoch")] if hours else []),
    )
    return out


def epoch_means(batches: DataFrame, by=("run_id", "epoch"), value: str = "loss", size: str = "batch_size") -> DataFrame:
    """Sample-weighted and unweighted epoch means of batch values."""
    return batches.groupBy(*by).agg(
        F.try_divide(F.sum(F.col(value) * F.col(size)), F.sum(size)).alias("weighted_mean"),
        F.avg(value).alias("batch_mean"),
    )
