"""Training-log queries over one run per user and one epoch per day."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoweave.operators import topk, trainlog
from phenoweave.registry.core import register, rounded

_W = "WINDOW w AS (PARTITION BY run_id ORDER BY epoch)"

register(
    "training_curves",
    lambda t: rounded(trainlog.curve_features(t.training_log), 8),
    f"""SELECT run_id, epoch, round(train_loss, 8) AS train_loss, round(val_loss, 8) AS val_loss, round(val_loss - train_loss, 8) AS gap,
      CASE WHEN val_loss - train_loss > 0 THEN 'overfitting' WHEN val_loss - train_loss <= 0 THEN 'underfitting' END AS fit,
      round(imp, 8) AS improvement,
      CASE WHEN count(imp) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN
        round(avg(imp) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 8) END AS smoothed_improvement,
      CASE WHEN n >= 10 THEN round(stddev_pop(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 8) END AS rolling_std
      FROM (SELECT *, lag(val_loss) OVER w - val_loss AS imp, count(*) OVER (PARTITION BY run_id) AS n FROM training_log {_W})""",
)
_RECORDS = f"""seen AS (SELECT *, row_number() OVER w - 1 AS position, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM training_log {_W}),
  marked AS (SELECT *, best_before IS NULL OR val_loss < best_before AS improved FROM seen),
  stalls AS (SELECT *, position - max(CASE WHEN improved THEN position END) OVER (PARTITION BY run_id ORDER BY epoch) AS stalled FROM marked)"""
register(
    "improvement_records",
    lambda t: rounded(
        trainlog.with_improvements(t.training_log).select("run_id", "epoch", "best_before", "improved", "stalled"), 8
    ),
    f"WITH {_RECORDS} SELECT run_id, epoch, round(best_before, 8) AS best_before, improved, stalled FROM stalls",
)
register(
    "early_stopping",
    lambda t: rounded(trainlog.early_stopping(t.training_log, patience=8), 8),
    f"""WITH {_RECORDS}, s AS (SELECT run_id, min(epoch) FILTER (WHERE stalled >= 8) AS stop_epoch FROM stalls GROUP BY 1)
      SELECT run_id, max(epoch) AS best_epoch, round(min(val_loss), 8) AS best_value, max(stop_epoch) AS stop_epoch
      FROM stalls JOIN s USING (run_id) WHERE improved AND epoch <= coalesce(stop_epoch, 1000) GROUP BY 1""",
)
# The sequential rule as a recursion over each run's rows.
_FOLD = """ordered AS (SELECT run_id, epoch, val_loss, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS k FROM training_log),
  fold AS (
    SELECT run_id, epoch, k, val_loss AS best, {start} FROM ordered WHERE k = 1
    UNION ALL SELECT o.run_id, o.epoch, o.k, CASE WHEN {better} THEN o.val_loss ELSE f.best END, {step}
    FROM fold f JOIN ordered o ON o.run_id = f.run_id AND o.k = f.k + 1)"""
register(
    "early_stopping_with_margin",
    lambda t: rounded(
        trainlog.with_improvements(t.training_log, min_delta=1.5).select("run_id", "epoch", "improved", "stalled"), 8
    ),
    "WITH RECURSIVE "
    + _FOLD.format(
        start="true AS improved, 0 AS stalled",
        better="o.val_loss < f.best - 1.5::DOUBLE",
        step="o.val_loss < f.best - 1.5::DOUBLE, CASE WHEN o.val_loss < f.best - 1.5::DOUBLE THEN 0 ELSE f.stalled + 1 END",
    )
    + " SELECT run_id, epoch, improved, stalled FROM fold",
)
_BETTER = "o.val_loss < f.best * (1 - 0.05::DOUBLE)"
register(
    "plateau_learning_rate",
    lambda t: trainlog.plateau_learning_rate(t.training_log, patience=2, threshold=0.05).select(
        "run_id", "epoch", F.round("replayed_rate", 12).alias("replayed_rate")
    ),
    "WITH RECURSIVE "
    + _FOLD.format(
        start="0 AS bad, 1e-4::DOUBLE AS rate, 1e-4::DOUBLE AS used",
        better=_BETTER,
        step=f"""CASE WHEN {_BETTER} OR f.bad + 1 > 2 THEN 0 ELSE f.bad + 1 END,
      CASE WHEN NOT ({_BETTER}) AND f.bad + 1 > 2 THEN greatest(f.rate * 0.5, 1e-6::DOUBLE) ELSE f.rate END, f.rate""",
    )
    + " SELECT run_id, epoch, round(used, 12) AS replayed_rate FROM fold",
)
register(
    "last_epochs",
    lambda t: rounded(trainlog.last_epochs(t.training_log, 5), 8),
    """SELECT run_id, epoch, round(train_loss, 8) AS train_loss, round(val_loss, 8) AS val_loss FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS n FROM training_log) WHERE n <= 5""",
)
register(
    "run_facts",
    lambda t: rounded(trainlog.run_facts(t.training_log.withColumn("hours", F.lit(12.5)), hours="hours"), 8),
    """SELECT run_id, count(*) AS epochs, CAST(arg_min(epoch, (val_loss, epoch)) AS INTEGER) AS best_epoch, round(min(val_loss), 8) AS best_val_loss,
      round(arg_max_null(train_loss, epoch), 8) AS final_train_loss, round(arg_max(val_loss, epoch), 8) AS final_val_loss,
      round(min(val_loss) - arg_min_null(train_loss, (val_loss, epoch)), 8) AS gap_at_best,
      round(arg_max(val_loss, epoch) - arg_max_null(train_loss, epoch), 8) AS final_gap,
      round((arg_min(val_loss, epoch) - min(val_loss)) / nullif(arg_min(val_loss, epoch), 0) * 100, 8) AS improvement_percent,
      round(12.5 * 60 / count(*), 8) AS minutes_per_epoch FROM training_log GROUP BY 1""",
)
register(
    "epoch_means",
    lambda t: rounded(
        trainlog.epoch_means(
            t.read("events").select(
                F.col("user_id").alias("run_id"),
                F.dayofmonth("ts").alias("epoch"),
                F.col("value").alias("loss"),
                (F.col("event_id") % 16 + 1).alias("batch_size"),
            )
        ),
        8,
    ),
    """SELECT user_id AS run_id, CAST(day(ts) AS INTEGER) AS epoch, round(sum(value * (event_id % 16 + 1)) / sum(event_id % 16 + 1), 8) AS weighted_mean,
      round(avg(value), 8) AS batch_mean FROM events GROUP BY 1, 2""",
)
register(
    "loss_histogram",
    lambda t: rounded(topk.histogram(t.training_log, "val_loss", 30)),
    """WITH b AS (SELECT min(val_loss) AS lo, max(val_loss) AS hi FROM training_log),
      c AS (SELECT CAST(least(floor((val_loss - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM training_log, b GROUP BY 1)
      SELECT CAST(k AS INTEGER) AS bin, round(lo + (hi - lo) / 30 * k, 6) AS left_edge, round(lo + (hi - lo) / 30 * (k + 1), 6) AS right_edge,
        coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, 29)) AS k) s LEFT JOIN c ON c.bin = k, b""",
)
