"""The corpus pipeline: stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from phenoweave.llm import decontaminate, line_dedup, near_text, pieces, toxicity
from phenoweave.llm.queries import vocabulary
from phenoweave.session import checkpoint_folder, text_batches


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half for toxicity."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share."""
    return line_dedup.remove_shared_lines(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    return near_text.remove_near_duplicates(docs)


def remove_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", remove_benchmark_documents),
    ("sentencepiece", encode_pieces),
]

# Hashing, a learnt model and a vocabulary are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/phenoweave/pipeline-{uuid.uuid4().hex}"
    text_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
