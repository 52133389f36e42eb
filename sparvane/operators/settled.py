"""Intermediate tables that several branches of a plan read: computed once, kept in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the driver and all executors see.

    Where the setting is unset, a local master gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    where, current = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return where or current.get()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "sparvane-checkpoints")
    context.setCheckpointDir(where)
    return where


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """Name of a new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/sparvane-{kind}-{uuid.uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """``rows``, written once to the shared folder and read from there, so that lost executors cost no recomputation."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)
