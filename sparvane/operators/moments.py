"""Means and covariances of vector columns from partial sums, their principal axes, and projections on these.

A partition keeps a mean and a matrix of centred products; partitions merge by twos of that kind in
two levels, so that neither a task nor the driver holds more than a few width x width matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIAL = "n long, mean binary, products binary"


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    products: np.ndarray

    def with_(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def covariance(self, ddof: int = 0) -> np.ndarray:
        return self.products / max(self.n - ddof, 1)


def block(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _partial(m: Moments | None) -> pa.RecordBatch:
    found = [] if m is None else [m]
    return pa.RecordBatch.from_arrays([pa.array([x.n for x in found], pa.int64()), *(pa.array([getattr(x, c).tobytes() for x in found], pa.binary()) for c in ("mean", "products"))], names=["n", "mean", "products"])


def _read(n: int, mean: bytes, products: bytes) -> Moments:
    centre = np.frombuffer(mean)
    return Moments(n, centre, np.frombuffer(products).reshape(len(centre), -1))


def moments(rows: DataFrame, vector: str) -> Moments | None:
    """Moments of an array column whose rows are of one width and without nulls; None without rows."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = block(batch.column(vector))
                centred = x - x.mean(axis=0)
                new = Moments(len(x), x.mean(axis=0), centred.T @ centred)
                total = new if total is None else total.with_(new)
        yield _partial(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "products"))):
                new = _read(*row)
                total = new if total is None else total.with_(new)
        yield _partial(total)

    groups = max(1, round(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    parts = rows.select(vector).mapInArrow(gather, PARTIAL).withColumn("grp", F.pmod(F.spark_partition_id(), F.lit(groups)))
    total = None
    for row in parts.repartition(groups, "grp").drop("grp").mapInArrow(merge, PARTIAL).collect():  # ``groups`` rows
        new = _read(*row)
        total = new if total is None else total.with_(new)
    return total


@dataclass
class Axes:
    """Principal axes: coordinates are (x - mean) / scale times ``weights`` (width x components)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shares: np.ndarray

    @staticmethod
    def fit(m: Moments, components: int, scaled: bool = False) -> Axes:
        """The leading axes, of standardised columns if ``scaled`` (constant ones count as 0); an axis' largest weight is positive."""
        cov = m.covariance()
        spread = np.sqrt(np.diag(cov)) if scaled else np.ones(len(cov))
        spread = np.where(spread <= 1e-12 * np.maximum(1, np.abs(m.mean)), 1.0, spread) if scaled else spread
        values, turn = np.linalg.eigh(cov / np.outer(spread, spread))
        values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
        turn = turn * np.where(turn[np.abs(turn).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
        k = max(1, min(components, len(values), m.n))
        return Axes(m.mean, spread, turn[:, :k], values[:k] / max(values.sum(), 1e-300))

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights


def enough(shares: np.ndarray, wanted: float = 0.95, most: int | None = None) -> int:
    """How many axes explain the wanted share, ``most`` at most."""
    return min(int(np.searchsorted(np.cumsum(shares), wanted)) + 1, most or len(shares), len(shares))


def project(rows: DataFrame, vector: str, axes: Axes, name: str = "coordinates") -> DataFrame:
    """``rows`` with the array of their coordinates in place of the vector."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    shared = rows.sparkSession.sparkContext.broadcast(axes)  # width x components
    schema = StructType([f for f in rows.schema if f.name != vector] + [StructField(name, ArrayType(DoubleType()))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(f.name) for f in target if f.name != name]
            out = shared.value.coordinates(block(batch.column(vector))) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(out), pa.list_(pa.float64()))], schema=target)

    return rows.mapInArrow(run, schema)
