"""Blocks of vectors, tiles of queries and the merging of their top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparvane.llm.common import fresh_folder

BLOCK, TILE, MERGE = 4096, 4096, 64


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Neither null nor holding a null or non-finite component (nor, on demand, zero throughout)."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return good & F.exists(vector, lambda x: x != 0) if nonzero else good


def clean(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """``vec_id, embedding array<double>, dim`` of the rows that take part: usable vectors with an id."""
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return chosen.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), nonzero)).withColumn("dim", F.size("embedding"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


Block = tuple[int, int, np.ndarray, np.ndarray]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """``dim, grp, ids, vectors`` of up to BLOCK rows of :func:`clean` each; ``grp`` deals the blocks out over MERGE groups for the first level of merging."""
    number = 0
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            for start in range(0, part.num_rows, BLOCK):
                rows = part.slice(start, BLOCK)
                ids, block = rows.column("vec_id").to_numpy(), matrix(rows.column("embedding"), dim)
                order = np.argsort(ids, kind="stable")
                yield dim, number % MERGE, ids[order], np.ascontiguousarray(block[order])
                number += 1


class Tiles:
    """Queries in files of about TILE rows in the shared folder; a task reads one at a time.

    So neither the vectors nor the queries are shuffled or broadcast to meet, and what a
    task holds is a block and a tile.
    """

    def __init__(self, folder: str, count: int) -> None:
        self.folder, self.count = folder, count

    @staticmethod
    def write(queries: DataFrame) -> Tiles:
        """One row an id of :func:`clean` rows."""
        folder = fresh_folder(queries.sparkSession, "tiles")
        queries = queries.dropDuplicates(["vec_id"])
        count = max(1, -(-queries.count() // TILE))

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(folder)
            system.create_dir(path, recursive=True)
            for batch in batches:
                for i in range(batch.num_rows):
                    dim, tile = batch.column("dim")[i].as_py(), batch.column("tile")[i].as_py()
                    rows = batch.column("queries")[i].values
                    ids, block = rows.field("vec_id").to_numpy(), matrix(rows.field("embedding"), dim)
                    order = np.argsort(ids)
                    name = f"{path}/{dim}-{tile}"
                    with system.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}", compression=None) as out:
                        out.write(ids[order].tobytes() + np.ascontiguousarray(block[order]).tobytes())
                    system.move(f"{name}.{TaskContext.get().taskAttemptId()}", name)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        dealt = queries.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
        rows = dealt.groupBy("dim", "tile").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
        rows.mapInArrow(save, "n long").agg(F.sum("n")).first()
        return Tiles(folder, count)

    def of(self, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and vectors of each tile of this dimension."""
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder)
        for tile in range(self.count):
            name = f"{path}/{dim}-{tile}"
            if system.get_file_info(name).type == fs.FileType.File:
                with system.open_input_stream(name, compression=None) as file:
                    data = file.readall()
                n = len(data) // (8 + 8 * dim)
                yield np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, offset=8 * n).reshape(n, dim)


def lists(grp: int, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """``query_id, grp, vec_id, score`` of (query ids, vector ids, scores)."""
    columns = [np.concatenate(x) for x in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(np.full(len(columns[0]), grp, np.int32)), *map(pa.array, columns[1:])], names=["query_id", "grp", "vec_id", "score"])


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal scores the first ones.  Not sorted."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def merge(lists: DataFrame, k: int) -> DataFrame:
    """Tree of two levels: each group's best k, then each query's best k with its rank."""
    for keys in (["query_id", "grp"], ["query_id"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
