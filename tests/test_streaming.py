import numpy as np
import pandas as pd
import pytest
import rasters
from pyspark.sql import functions as F

from phenoweave.operators import trainlog
from phenoweave.plans import colour as colour_plan
from phenoweave.streaming import jobs


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_only_new_images_are_processed(spark, tmp_path):
    folder = tmp_path / "photos" / "device3"
    folder.mkdir(parents=True)
    out, checkpoint = str(tmp_path / "catalogue"), str(tmp_path / "checkpoint")

    def run():
        finish(jobs.append_new_images(jobs.new_images(spark, str(tmp_path / "photos")), out, checkpoint))
        return sorted(r["plot"] for r in spark.read.parquet(out).collect())

    rasters.write_png(folder / "11_a.png", np.zeros((2, 2)))
    assert run() == [11]
    rasters.write_png(folder / "12_b.png", np.zeros((2, 2)))
    assert run() == [11, 12]
    assert run() == [11, 12]


def test_streaming_statistics_equal_the_batch(spark, tables, tmp_path):
    pixels = tables.pixels
    pixels.repartition(4).write.parquet(str(tmp_path / "pixels"))
    stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pixels"))
    query = (
        jobs.channel_statistics(stream, ["r", "g", "b"]).writeStream.outputMode("complete").format("memory")
        .queryName("running_statistics").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    finish(query)
    got = spark.table("running_statistics").first().asDict()
    want = colour_plan.channel_statistics(pixels, ["r", "g", "b"]).first().asDict()
    assert got == {k: pytest.approx(v) for k, v in want.items()}


@pytest.fixture()
def log_files(spark, tmp_path):
    """A log arriving in four files, with a repeated and a late epoch."""
    rng = np.random.default_rng(2)
    rows = [(run, e, float(v), float(v)) for run in (1, 2) for e, v in enumerate(5 + rng.random(60), 1)]
    pdf = pd.DataFrame(rows, columns=["run_id", "epoch", "train_loss", "val_loss"])
    schema = "run_id int, epoch int, train_loss double, val_loss double"
    for part in range(4):
        piece = pdf[(pdf.epoch - 1) // 15 == part].sample(frac=1, random_state=part)
        if part == 2:
            piece = pd.concat([piece, pdf[pdf.epoch == 3].assign(val_loss=0.0)])
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return str(tmp_path / "log"), schema, spark.createDataFrame(pdf, schema)


def test_log_append_and_running_best(spark, log_files, tmp_path):
    path, schema, log = log_files
    stream = jobs.read_log_stream(spark, path, schema, max_files=1)
    finish(jobs.append_log(stream, str(tmp_path / "out"), str(tmp_path / "c1")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == log.count() + 2
    # The same checkpoint has nothing to add; a new one starts at batch 0 again and overwrites nothing.
    finish(jobs.append_log(stream, str(tmp_path / "out"), str(tmp_path / "c1")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == log.count() + 2
    finish(jobs.append_log(stream, str(tmp_path / "out"), str(tmp_path / "c3")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * (log.count() + 2)
    query = (
        jobs.running_best(jobs.read_log_stream(spark, path, schema)).writeStream.outputMode("update").format("memory")
        .queryName("running_best").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    )
    finish(query)
    final = spark.table("running_best").groupBy("run_id").agg(F.min("best_value")).collect()
    assert {r["run_id"]: r[1] for r in final} == {1: 0.0, 2: 0.0}


def test_stopping_rules_equal_the_batch_operators(spark, log_files, tmp_path):
    path, schema, log = log_files
    stream = jobs.read_log_stream(spark, path, schema, max_files=1)
    out = jobs.stopping_rules(stream, patience=1000, rate_patience=3)
    query = (
        out.writeStream.outputMode("append").format("memory").queryName("stopping")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    finish(query)
    got = spark.table("stopping").filter("not late").orderBy("run_id", "epoch").collect()
    # The epoch that came again in a later batch is told of and changes nothing.
    assert sorted((r["run_id"], r["epoch"], r["val_loss"]) for r in spark.table("stopping").filter("late").collect()) == [(1, 3, 0.0), (2, 3, 0.0)]
    rates = trainlog.plateau_learning_rate(log, patience=3).orderBy("run_id", "epoch").collect()
    stalls = trainlog.with_improvements(log).orderBy("run_id", "epoch").collect()
    assert [(r["run_id"], r["epoch"], r["stalled"]) for r in got] == [(r["run_id"], r["epoch"], r["stalled"]) for r in stalls]
    assert [r["rate"] for r in got] == pytest.approx([r["replayed_rate"] for r in rates])


def test_stopped_runs_stay_stopped(spark, log_files, tmp_path):
    path, schema, log = log_files
    out = jobs.stopping_rules(jobs.read_log_stream(spark, path, schema, max_files=1), patience=4)
    query = (
        out.writeStream.outputMode("append").format("memory").queryName("stopped")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    finish(query)
    last = spark.table("stopped").groupBy("run_id").agg(F.max("epoch").alias("e")).collect()
    want = {r["run_id"]: r["stop_epoch"] for r in trainlog.early_stopping(log, patience=4).collect()}
    assert {r["run_id"]: r["e"] for r in last} == want
