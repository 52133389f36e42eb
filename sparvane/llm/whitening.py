"""Whitening of embeddings by principal components, with exact integer sums beside streamed moments.

A partition runs Welford's rank-one updates over its distinct vectors: each vector adds the
outer product of its distances from the mean before it and the mean after it.  A block's
means come from cumulated distances, so that its rank-one updates are one matrix product.
Partitions merge by the parallel update formula, in two levels.  The covariance is reduced to
tridiagonal form and diagonalised by implicit symmetric QR steps.

A task and the driver hold a few matrices of width x width numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparvane.llm.common import fresh_folder, map_batches, remove_folder
from sparvane.llm.vectors import usable

BLOCK, LARGEST = 1024, 2**63 - 1


@dataclass
class Moments:
    """Number of rows, their exact sums, mean and centred products."""

    width: int
    n: int = 0
    sums: np.ndarray = field(default=None)
    mean: np.ndarray = field(default=None)
    products: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.sums is None:
            self.sums, self.mean, self.products = np.zeros(self.width, np.int64), np.zeros(self.width), np.zeros((self.width, self.width))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update by each row in turn."""
        for start in range(0, len(rows), BLOCK):
            block = rows[start : start + BLOCK]
            origin = self.mean if self.n else block[0].astype(float)
            away = block - origin
            means = np.cumsum(away, axis=0) / (self.n + np.arange(1, len(block) + 1))[:, None]
            before = np.vstack([np.zeros(self.width), means[:-1]])
            self.products += (away - before).T @ (away - means)
            self.mean, self.n = origin + means[-1], self.n + len(block)
            if block.dtype == np.int64:
                self.sums += block.sum(axis=0)

    def merge(self, other: Moments) -> None:
        if other.n:
            n, apart = self.n + other.n, other.mean - self.mean
            self.products += other.products + np.outer(apart, apart) * (self.n * other.n / n)
            self.mean, self.n, self.sums = self.mean + apart * (other.n / n), n, self.sums + other.sums

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / 2 / self.n

    @staticmethod
    def read(row: dict) -> Moments:
        width = row["width"]
        return Moments(width, row["n"], np.frombuffer(row["sums"], np.int64).copy(), np.frombuffer(row["mean"]).copy(), np.frombuffer(row["products"]).reshape(width, width).copy())


MOMENTS = "fit int, width int, n long, sums binary, mean binary, products binary"


def _sent(states: dict[int, Moments]) -> pa.RecordBatch:
    found = sorted(states.items())
    columns = [[fit for fit, _ in found], [m.width for _, m in found], [m.n for _, m in found], *([getattr(m, c).tobytes() for _, m in found] for c in ("sums", "mean", "products"))]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["fit", "width", "n", "sums", "mean", "products"])


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, places and rows of the arrays of each width."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        yield width, at, flat[starts[at][:, None] + np.arange(width)]


def moments(rows: DataFrame, vector: str, project: dict | None = None) -> dict[int, Moments]:
    """Moments of the rows of each width, by that width; with ``project`` (by width) of what its function makes of them.

    The driver gets width x width numbers from each of about the root of the number of partitions.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Moments] = {}
        for batch in batches:
            for width, _, block in by_width(batch.column(vector)):
                block = project[width].whitened(block) if project else block
                states.setdefault(width, Moments(block.shape[1])).add(block)
        yield _sent(states)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Moments] = {}
        for batch in batches:
            for row in batch.to_pylist():
                states.setdefault(row["fit"], Moments(row["width"])).merge(Moments.read(row))
        yield _sent(states)

    groups = max(1, round(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    parts = rows.mapInArrow(gather, MOMENTS).withColumn("grp", F.pmod(F.spark_partition_id(), F.lit(groups)))
    merged = parts.repartition(groups, "grp").drop("grp").mapInArrow(merge, MOMENTS)
    out: dict[int, Moments] = {}
    for row in merged.collect():  # groups times widths
        out.setdefault(row["fit"], Moments(row["width"])).merge(Moments.read(row.asDict()))
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q' of a symmetric matrix Q T Q', by reflections."""
    a, n = matrix.astype(float).copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: implicit QR steps with Wilkinson's shift on the tridiagonal form."""
    d, e, q = tridiagonal(matrix)
    last, tiny = len(d) - 1, np.finfo(float).eps
    while last > 0:
        e[np.abs(e) <= tiny * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0.0
        if e[last - 1] == 0:
            last -= 1
            continue
        zeros = np.flatnonzero(e[:last] == 0)
        first = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[last - 1] - d[last]) / 2
        x = d[first] - d[last] + e[last - 1] ** 2 / (half + np.copysign(np.hypot(half, e[last - 1]), half))
        z = e[first]
        for k in range(first, last):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            a, b, off = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * a + 2 * c * s * off + s * s * b, s * s * a - 2 * c * s * off + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * off
            if k < last - 1:
                x, z, e[k + 1] = e[k], s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


@dataclass
class Model:
    """What whitens vectors of one width."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # width x k, over the roots of the eigenvalues; NaN without variance
    explained: np.ndarray
    identity_error: float | None = None

    @staticmethod
    def fit(m: Moments, components: int) -> Model:
        values, vectors = symmetric_qr(m.covariance())
        k, total = min(components, m.width), float(np.trace(m.covariance()))
        flat = values[:k] <= max(values[0], 0) * m.width * np.finfo(float).eps
        roots = np.sqrt(np.where(flat, 1.0, values[:k]))
        return Model(m.n, m.sums, np.where(flat, np.nan, vectors[:, :k] / roots), np.where(flat, 0.0, values[:k]) / total if total > 0 else np.full(k, np.nan))

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.sums / self.n) @ self.components

    def deviation(self, rows: np.ndarray) -> np.ndarray:
        away = max(int(abs(rows).max()) * self.n, int(abs(self.sums).max())) if rows.size else 0
        if away <= LARGEST // 4 and (far := self.n * rows - self.sums).size and int(abs(far).max()) ** 2 * far.shape[1] <= LARGEST:
            return (far * far).sum(axis=1)
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums.tolist())) for row in rows.tolist()]
        if max(exact, default=0) > LARGEST:
            raise OverflowError("a deviation is beyond 64 bits")
        return np.array(exact, np.int64)


def whole(vector: Column, scale: int, shift: int) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(scale * c) + shift)


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each usable vector and component.

    Rows whose vector is null or holds a null or non-finite entry are dropped; equal vectors
    count once in the fit, and each of their rows is returned, null ids too.  Vectors of
    another length are a fit of their own; empty ones have no component.  A component without
    variance has a null ``whitened`` and takes no part in ``identity_error``; if there is none
    with variance, that and ``explained`` are null.  An empty table gives no rows; other
    columns are ignored.  A deviation or entry beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    clean = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")) & (F.size("embedding") > 0))
    rows = clean.select("vec_id", whole(F.col("embedding"), scale, shift).alias("x"))
    folder = fresh_folder(spark, "fit")
    rows.select("x").distinct().write.parquet(folder)  # read twice
    fit = spark.read.schema("x array<bigint>").parquet(folder)
    models = {w: Model.fit(m, components) for w, m in moments(fit, "x").items()}
    for w, m in moments(fit, "x", models).items() if models else ():
        good = ~np.isnan(models[w].explained) & ~np.isnan(models[w].components[0])
        apart = np.abs(m.covariance()[np.ix_(good, good)] - np.eye(good.sum()))
        models[w].identity_error = float(apart.max()) if apart.size else None
    remove_folder(spark, folder)
    shared = spark.sparkContext.broadcast(models)  # width x components numbers a width

    def work():
        def step(c: dict) -> dict:
            ids, out = c["vec_id"], []
            for width, at, block in by_width(c["x"]):
                m = shared.value[width]
                k = m.components.shape[1]
                error = np.full(len(at) * k, np.nan if m.identity_error is None else m.identity_error)
                out.append((np.repeat(at, k), np.tile(np.arange(1, k + 1), len(at)), np.full(len(at) * k, m.n), np.repeat(m.deviation(block), k), m.whitened(block).ravel(), np.tile(m.explained, len(at)), error))
            at, component, n, deviation, *doubles = map(np.concatenate, zip(*out)) if out else [np.zeros(0, int)] * 7
            exact = {"component": pa.array(component.astype(np.int32)), "n": pa.array(n.astype(np.int64)), "deviation": pa.array(deviation.astype(np.int64))}
            return {"vec_id": ids.take(pa.array(at)), **exact, **{name: pa.array(x.astype(float), from_pandas=True) for name, x in zip(("whitened", "explained", "identity_error"), doubles)}}

        return step

    kind = rows.schema["vec_id"].dataType.simpleString()
    return map_batches(rows, work, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
