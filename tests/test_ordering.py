import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from phenoweave.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; null and tiny keys are there as well."""
    rng = np.random.default_rng(1)
    n = 6000
    keys = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    keys[:5] = None
    pdf = pd.DataFrame({"k": keys, "id": np.arange(n), "v": rng.integers(0, 400, n) / 7.0})
    return spark.createDataFrame(pdf, "k string, id bigint, v double").repartition(8)


@pytest.mark.parametrize("parts", [60, None])
def test_running_values_equal_a_plain_window(skewed, parts):
    w = Window.partitionBy("k").orderBy("v", "id")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select(
        "id", (F.row_number().over(w) - 1).cast("bigint").alias("p"), F.min(F.col("id") % 977).over(prior).alias("m"),
        F.max("v").over(Window.partitionBy("k")).alias("t"),
    )
    got = ordering.running(
        skewed, ["k"], ["v", "id"],
        {"p": ("sum", F.lit(1).cast("bigint")), "m": ("min", F.col("id") % 977)},
        inclusive=False, totals={"t": ("max", F.col("v"))}, parts=parts,
    ).select("id", "p", "m", "t")
    assert sorted(got.collect()) == sorted(want.collect())


def test_hot_key_is_cut_into_many_parts(skewed):
    parts = ordering.aligned(skewed, ["k"], ["v", "id"], parts=60).filter("k = 'hot'").groupBy("_part").count()
    sizes = [r["count"] for r in parts.collect()]
    assert len(sizes) > 30 and max(sizes) < 600


def test_global_positions(skewed):
    got = ordering.positions(skewed, [], ["v", "id"], total="n", parts=90).orderBy("v", "id").select("position", "n").collect()
    assert [tuple(r) for r in got] == [(i, 6000) for i in range(6000)]


def test_plans_read_the_rows_once(spark, skewed):
    """Two scans, of the rows and of the starts of the parts, and few exchanges; without broadcasts as well."""
    measures = {"p": ("sum", F.lit(1).cast("bigint"))}
    positioned = ordering.positions(skewed, ["k"], ["v", "id"])
    plans = {
        "running": (ordering.running(skewed, ["k"], ["v", "id"], measures), 2),
        "positions": (positioned, 2),
        "framed": (ordering.framed(positioned, ["k"], "position", 3, 3, {"s": lambda w: F.sum("id").over(w.rowsBetween(-3, 3))}), 3),
        "quantiles": (ordering.quantiles(skewed, ["k"], "v", {"m": 0.5}), 8),
    }
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, (df, most) in plans.items():
            plan = df.select("*")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert plan.count("Exchange ") <= most, (name, plan)
            assert plan.count("FileScan") <= (3 if name == "quantiles" else 2), (name, plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_order_keys_order_like_the_doubles(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    random = bits.view(np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    near = np.concatenate([np.nextafter(powers, 0), powers, np.nextafter(powers, np.inf)])
    values = np.concatenate([random[~np.isnan(random)], near, -near, [0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.7976931348623157e308]])
    got = spark.createDataFrame(pd.DataFrame({"v": values})).select("v", ordering.order_key(F.col("v")).alias("o")).toPandas()
    raw = np.abs(got.v.to_numpy()).view(np.int64)
    assert (got.o.to_numpy() == np.where(got.v < 0, -raw, raw)).all()
    odd = spark.createDataFrame([(float("nan"),), (-0.0,), (0.0,), (None,)], "v double").select(ordering.order_key(F.col("v"))).collect()
    assert odd[0][0] > 0x7FF << 52 and odd[1][0] == odd[2][0] == 0 and odd[3][0] is None


@pytest.mark.parametrize("bucket_rows", [1, 20, 100_000])
def test_quantiles_match_linear_interpolation(skewed, bucket_rows):
    wanted = {"q1": 0.25, "med": 0.5, "q9": 0.937, "hi": 1.0}
    mixed = skewed.withColumn("v", F.when(F.col("id") % 5 == 0, -F.col("v") * 1e-9).when(F.col("id") % 7 == 0, F.lit(3.25)).otherwise(F.col("v")))
    got = ordering.quantiles(mixed, ["k"], "v", wanted, bucket_rows=bucket_rows).toPandas()
    pdf = mixed.toPandas()
    assert len(got) == pdf.k.nunique(dropna=False)
    for _, row in got.iterrows():
        values = pdf[pdf.k.isna() if row.k is None else pdf.k == row.k].v
        for name, p in wanted.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_framed_windows_cross_block_edges(skewed):
    indexed = ordering.positions(skewed, ["k"], ["v", "id"])
    w = Window.partitionBy("k").orderBy("v", "id")
    want = skewed.select("id", F.sum("id").over(w.rowsBetween(-10, 2)).alias("s"), F.lag("id", 3).over(w).alias("l"))
    got = ordering.framed(
        indexed, ["k"], "position", 10, 2,
        {"s": lambda s: F.sum("id").over(s.rowsBetween(-10, 2)), "l": lambda s: F.lag("id", 3).over(s)},
        block_rows=37,
    ).select("id", "s", "l")
    assert sorted(got.collect()) == sorted(want.collect())


def test_result_does_not_depend_on_the_layout(skewed):
    a = ordering.positions(skewed.repartition(3), ["k"], ["v", "id"], parts=40).select("id", "position")
    b = ordering.positions(skewed.coalesce(1), ["k"], ["v", "id"], parts=7).select("id", "position")
    assert sorted(a.collect()) == sorted(b.collect())


def test_a_hot_key_leaves_a_keyed_layout(skewed):
    """Even when the input is already partitioned by the key, its parts spread."""
    keyed = skewed.repartition(8, "k")
    out = ordering.running(keyed, ["k"], ["v", "id"], {"p": ("sum", F.lit(1).cast("bigint"))}, parts=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(_key" in line and "_part" in line for line in plan.splitlines())
    per_task = (
        ordering.aligned(keyed, ["k"], ["v", "id"], parts=50).repartition(8, "_key", "_part")
        .filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    )
    assert len(per_task) == 8
