"""Incremental run features: the batch aggregation over a stream of corpus rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.functions import lexicon


def stream_corpus(spark: SparkSession, folder: str, schema: str = "agent string, run int, text string") -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def run_totals(rows: DataFrame) -> DataFrame:
    """Files and structural counts by agent and run; works on batches and on streams (complete or update mode)."""
    counted = rows.select("agent", "run", *(c.alias(n) for n, c in lexicon.structure(F.col("text")).items()))
    return counted.groupBy("agent", "run").agg(F.count("*").alias("n_files"), *(F.sum(c).alias(c) for c in counted.columns[2:]))
