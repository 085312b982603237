"""Incremental forms: new files, running statistics, logs, stopping rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phenoweave import schemas
from phenoweave.sources.rasters import catalogue_columns


def new_images(spark: SparkSession, base_dir: str, max_files: int = 10_000) -> DataFrame:
    """Stream of catalogue rows; the query's checkpoint remembers files already seen."""
    listing = (
        spark.readStream.format("binaryFile")
        .schema(schemas.BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(base_dir)
    )
    return catalogue_columns(listing, base_dir)


def append_new_images(images: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append unseen images to a Parquet catalogue and stop when none are left."""
    return (
        images.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def channel_statistics(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Running mean, population deviation and count of masked pixels (complete mode)."""
    return (
        pixels.filter("in_mask")
        .groupBy()
        .agg(
            F.count(F.lit(1)).alias("pixels"),
            *[f(c).alias(f"{n}_{c}") for c in channels for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
        )
    )


def read_log_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def append_log(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to a folder of its own query and number; a replayed batch overwrites itself only.

    A query is what its checkpoint says it is, so one with a new checkpoint, which counts its batches anew, leaves
    what is there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        about = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").head()[0]
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/query={json.loads(about)['id']}/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_best(log: DataFrame, run: str = "run_id", value: str = "val_loss") -> DataFrame:
    """Best value and epoch per run so far (update mode)."""
    return log.groupBy(run).agg(
        F.min(value).alias("best_value"), F.min_by("epoch", F.struct(value, "epoch")).alias("best_epoch"),
        F.count(F.lit(1)).alias("epochs"),
    )


STATE = "last_epoch int, best double, plateau_best double, stalled int, bad int, rate double, stopped boolean"


def stopping_rules(
    log: DataFrame, patience: int = 15, min_delta: float = 0.0, rate: float = 1e-4, factor: float = 0.5,
    rate_patience: int = 5, threshold: float = 1e-4, minimum: float = 1e-6, run: str = "run_id",
) -> DataFrame:
    """Per epoch: early-stopping counter, stop flag and the learning rate in force.

    State per run is seven numbers. An epoch at or before the last one seen, late or a
    repetition, is returned with ``late`` set and changes nothing. After a stop no epochs are returned. The rows of a run in one micro-batch are sorted by
    epoch in memory; the reader's ``max_files`` bounds a micro-batch.
    """
    key_type = log.schema[run].dataType.simpleString()
    output = f"{run} {key_type}, epoch int, val_loss double, best double, stalled int, stopped boolean, rate double, late boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, best, plateau, stalled, bad, current, stopped = (
            state.get if state.exists else (-1, float("inf"), float("inf"), 0, 0, rate, False)
        )
        rows = pd.concat(list(batches)).sort_values("epoch", kind="stable")
        out = []
        for epoch, value in zip(rows["epoch"].tolist(), rows["val_loss"].tolist()):
            if stopped:
                continue
            if epoch <= last:
                out.append((key[0], epoch, value, best, stalled, stopped, current, True))
                continue
            last, used = epoch, current
            if value < best - min_delta:
                best, stalled = value, 0
            else:
                stalled += 1
            stopped = stalled >= patience
            if value < plateau * (1 - threshold):
                plateau, bad = value, 0
            else:
                bad += 1
            if bad > rate_patience:
                current, bad = max(current * factor, minimum), 0
            out.append((key[0], epoch, value, best, stalled, stopped, used, False))
        state.update((int(last), float(best), float(plateau), int(stalled), int(bad), float(current), bool(stopped)))
        yield pd.DataFrame(out, columns=[run, "epoch", "val_loss", "best", "stalled", "stopped", "rate", "late"])

    return (
        log.select(run, F.col("epoch").cast("int").alias("epoch"), F.col("val_loss").cast("double").alias("val_loss"))
        .groupBy(run)
        .applyInPandasWithState(step, output, STATE, "append", GroupStateTimeout.NoTimeout)
    )
