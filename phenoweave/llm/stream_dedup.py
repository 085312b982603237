"""Exact deduplication by a stateful stream, in DataFrame functions only.

A file stream reduces every row to a digest of its normalised text, its
identifier and its locator (file and row in the file). A streaming aggregation
keeps, for each digest and without expiry, how many rows had it and the
identifier and locator of the row that stays; the state lies in RocksDB on the
executors' disks and, after each micro-batch, in the checkpoint folder. No text
is ever held there. Later files are absorbed by calling :func:`absorb` again:
only they are read.

Whether equal digests are equal texts is not taken on trust: texts of digests
seen more than once (hits) are compared byte by byte with the text at the kept
locator, and a digest that hides several texts is regrouped by text.

Defined cases: a null text counts as empty; the largest identifier of a group
stays, nulls below all others; rows that tie in it too are told apart by their
locator, so that one row of a group is kept always; a group without identifiers
has a null ``keep_id``; extra columns are ignored, whatever their names; a
table without rows gives none.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from phenoweave.session import checkpoint_folder, durable

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # All stores of an executor share one bounded cache and its write buffers.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # A store would reserve some 4 MB of disk ahead of what it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
BATCH_BYTES = 256 << 30  # of files in one micro-batch
BROADCAST_HITS = 1_000_000  # digests of 32 bytes that are sent to all executors; more are joined by a shuffle


def same_text(text: Column) -> Column:
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _located(files: DataFrame, doc_id: str, text: str, normalise: Callable, digest: Callable) -> DataFrame:
    """(id, text, digest, at): ``at`` is the row's file and its number in it."""
    place = files.metadataColumn("_metadata")
    words = normalise(F.coalesce(files[text].cast("string"), F.lit("")))
    at = F.struct(place["file_path"].alias("file"), place["row_index"].alias("row"))
    return files.select(files[doc_id].alias("id"), words.alias("text"), digest(words).alias("digest"), at.alias("at"))


def absorb(
    spark: SparkSession, path: str, folder: str, schema: T.StructType, doc_id: str = "doc_id", text: str = "text",
    normalise: Callable[[Column], Column] = same_text, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES,
) -> None:
    """Bring the state in ``folder`` up to date with the Parquet files at ``path``; files seen before are skipped."""
    # A pattern lets the source accept a single file as well as a folder. No file is ever too old.
    files = (
        spark.readStream.schema(schema).option("maxFileAge", "36500d").option("maxBytesPerTrigger", batch_bytes)
        .parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")
    )
    rows = _located(files, doc_id, text, normalise, digest).select("digest", F.struct("id", "at").alias("row"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("row").alias("keeper"))
    with _settings(spark, STATE_CONF):
        run = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
    run.awaitTermination()


def held(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, keeper) for every digest in the state."""
    state = spark.read.format("statestore").load(folder)
    count, keeper = state.schema["value"].dataType.names
    return state.select("key.digest", F.col("value")[count].alias("n"), F.col("value")[keeper].alias("keeper"))


def _only(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows with one of the digests; few are sent to the rows, many are joined by a shuffle."""
    return rows.join(F.broadcast(digests) if digests.count() <= BROADCAST_HITS else digests, "digest", "left_semi")


def decisions(
    spark: SparkSession, path: str, folder: str, schema: T.StructType, doc_id: str = "doc_id", text: str = "text",
    normalise: Callable[[Column], Column] = same_text, digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(id, keep_id, group_size, kept, sha256, at) of every absorbed row; ``sha256`` is of the normalised text.

    Rows of files that are not absorbed yet are left out.
    """
    rows = _located(spark.read.schema(schema).parquet(path), doc_id, text, normalise, digest)
    state = durable(held(spark, folder), "dedup-state")
    hits = state.filter("n > 1")
    copies = _only(rows, hits.select("digest"))
    # The kept row's text, found by its locator, against that of every other row of the digest.
    originals = copies.join(hits.select(F.col("keeper.at").alias("at"), "digest"), ["digest", "at"], "left_semi").select("digest", F.col("text").alias("original"))
    # Written as they come, so that the join's hot digests can be split; nearly always there are none.
    unequal = durable(copies.join(originals, "digest").filter("text <> original").select("digest"), "dedup-collisions").distinct()
    labelled = rows.select("id", "digest", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), "at").join(state, "digest")
    columns = ["id", F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keeper.at")).alias("kept"), "sha256", "at"]
    if unequal.isEmpty():
        return labelled.select(*columns)
    several = _only(rows, unequal)
    texts = several.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("id", "at")).alias("keeper"))
    split = several.join(texts, ["digest", "text"]).withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    return labelled.join(unequal, "digest", "left_anti").select(*columns).unionByName(split.select(*columns))


def deduplicate(spark: SparkSession, path: str, **how) -> DataFrame:
    """All files at ``path`` absorbed into a new state, and the decision on each row."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/phenoweave/stream-dedup-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    absorb(spark, path, folder, schema, **how)
    how.pop("batch_bytes", None)
    return decisions(spark, path, folder, schema, **how)
