"""Helpers that several operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Scan one table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session names none, a local master (tests, one machine) gets a temporary
    folder; on a cluster that is an error, as executors would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return where or current.get()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "sparvane-checkpoints")
    spark.sparkContext.setCheckpointDir(where)
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """Name of a new folder below the shared folder; whoever writes there creates it."""
    return f"{shared_dir(spark).rstrip('/')}/sparvane-{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of :func:`fresh_folder` and all in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Tables in a folder of their own in the shared folder; each is read again instead of being computed twice."""

    def __init__(self, spark: SparkSession, kind: str) -> None:
        self.spark, self.folder, self.count = spark, fresh_folder(spark, kind), 0

    def keep(self, rows: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


@contextmanager
def steady_scans(spark: SparkSession) -> Iterator[None]:
    """Meanwhile all scans of a table split it alike, whatever executors come and go, batches for Python stay small, and shuffle files go when their job ends."""
    wanted = {
        "spark.sql.files.minPartitionNum": spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism),
        "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_CACHES: list[Callable[[], object]] = []


def forgettable(clear: Callable[[], object]) -> None:
    """Registers how to empty what a module remembers in a worker beyond a task."""
    _CACHES.append(clear)


def forget() -> None:
    """Empties them: workers go from one operator's tasks to another's, and memory is for the one at work."""
    for clear in _CACHES:
        clear()


def map_batches(df: DataFrame, work: Callable[[], Callable[[dict], dict]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a state made once per task.

    ``work()`` runs on the executor and returns a function from a batch's columns
    (name to Arrow array) to the columns of the output batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            out = step({f.name: batch.column(i) for i, f in enumerate(batch.schema)})
            arrays = [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type, from_pandas=False) for x, f in zip((out[f.name] for f in target), target)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


ROW, CHECK = "__sparvane_row", "__sparvane_check"


def numbered(df: DataFrame, content: Column) -> DataFrame:
    """Adds ROW, partition and place of each row in a scan, and CHECK, a hash of its ``content``.

    Another scan may number rows differently (other splits, another order), so whoever
    picks rows by their numbers compares CHECK as well.
    """
    return df.withColumns({ROW: F.monotonically_increasing_id(), CHECK: F.xxhash64(content)})


def write_row_sets(rows: DataFrame) -> tuple[str, int]:
    """Writes the numbers in column ROW with their CHECK, one file for each scan partition that has some; returns the folder and how many.

    With these a later scan picks its rows itself, and nothing but numbers is shuffled.
    """
    spark = rows.sparkSession
    folder, tasks = fresh_folder(spark, "rows"), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        attempt, part, held, written = TaskContext.get().taskAttemptId(), None, [], 0

        def flush() -> None:
            nonlocal written
            if part is not None:
                with system.open_output_stream(f"{path}/{part}.{attempt}", compression=None) as out:
                    out.write(np.concatenate(held).tobytes())
                system.move(f"{path}/{part}.{attempt}", f"{path}/{part}")  # all attempts write the same
                written += sum(map(len, held))

        for batch in batches:
            numbers = np.stack([batch.column(ROW).to_numpy(), batch.column(CHECK).to_numpy()], 1)
            for piece in np.split(numbers, np.flatnonzero(np.diff(numbers[:, 0] >> 33)) + 1) if len(numbers) else []:
                if int(piece[0, 0] >> 33) != part:
                    flush()
                    part, held = int(piece[0, 0] >> 33), []
                held.append(piece)
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

    dealt = rows.select(ROW, CHECK).repartition(tasks, F.shiftright(ROW, 33)).sortWithinPartitions(ROW)
    return folder, dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def pick_rows(numbered_df: DataFrame, folder: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """Those rows of a numbered scan that :func:`write_row_sets` wrote; fails if a number stands for other content.

    Rows that this scan lacks show in the number of rows only: see :func:`all_there`.
    ``then`` turns each batch of picked rows into one of ``schema``, in the same worker: two
    functions in a row would hold two workers a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        part, chosen = None, np.zeros((0, 2), np.int64)
        for batch in batches:
            numbers = batch.column(ROW).to_numpy()
            if len(numbers) and int(numbers[0] >> 33) != part:
                part = int(numbers[0] >> 33)
                there = system.get_file_info(f"{path}/{part}").type == fs.FileType.File
                chosen = np.frombuffer(system.open_input_file(f"{path}/{part}").readall(), np.int64).reshape(-1, 2) if there else chosen[:0]
            at = np.minimum(np.searchsorted(chosen[:, 0], numbers), max(len(chosen) - 1, 0))
            picked = chosen[at, 0] == numbers if len(chosen) else np.zeros(len(numbers), bool)
            if (chosen[at[picked], 1] != batch.column(CHECK).to_numpy()[picked]).any():
                raise RuntimeError("two scans number the rows differently: a chosen number stands for other content")
            kept = batch.filter(pa.array(picked))
            yield then(kept) if then else kept

    return numbered_df.mapInArrow(run, schema) if then else numbered_df.mapInArrow(run, numbered_df.schema).drop(ROW, CHECK)


def all_there(picked: DataFrame, n: int) -> DataFrame:
    """``picked`` (written, so that it can't change any more), if it has ``n`` rows; else fails."""
    found = picked.count()
    if found != n:
        raise RuntimeError(f"two scans number the rows differently: {found} of {n} chosen rows were found")
    return picked
