"""Session helpers: durable intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Joins carry no broadcast hints: Spark
# broadcasts a side only when its measured size is under the threshold, and
# otherwise splits skewed partitions of the shuffled join. Shuffles begin with many
# partitions and are coalesced to a small size, so that a task's share of a large
# input does not grow with it.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Rows of documents that meet in a Python worker at once. A batch is held by the
# worker and by Spark, whole texts included, twice where texts are returned.
BATCH_ROWS = 2_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS``; smaller ones stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def numeric_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows alone: for rows of a few numbers.

    With a bound in bytes Spark measures the batch after every row, which costs more than to send the row.
    """
    spark.conf.set(BATCH_BYTES, str(2**31 - 1))


def text_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes as the session was set up to: for rows that hold texts."""
    spark.conf.unset(BATCH_BYTES)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session created elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "phenoweave") -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="phenoweave-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the files.

    Cuts the lineage of iterative operators. The files are on shared storage, so
    losing an executor never loses them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/phenoweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
