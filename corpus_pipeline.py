"""Cleaning pipeline over ``documents``: each stage reads what its predecessor has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparvane.llm import neardup, packing, pii, toxicity
from sparvane.llm.common import fresh_folder, read, remove_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(spark: SparkSession) -> None:
    """Batches for Python stay small while a stage's result is written: a very long text may come with many others."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 stay, unchanged; the models learn from the labelled ones among ``docs``."""
    _small_batches(spark)
    return toxicity.keep_ordinary(docs, read(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    _small_batches(spark)
    return neardup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans of personal data become their kind in angle brackets."""
    _small_batches(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most 4096 tokens."""
    _small_batches(spark)
    return packing.pack(docs, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None  # trained models and packing are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written as Parquet and read again, then what it read is removed.

    Null texts count as empty ones: they are ordinary, equal to each other, hold nothing
    personal and pack as their end token.  Very long texts go through whole.  Of repeated rows and near copies one
    document stays, that of the smallest id; null ids come last.  Further columns travel
    along up to the packing, whatever their names.  An empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    folder, before = fresh_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
