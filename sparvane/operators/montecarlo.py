"""Clouds of synthetic points about producers' run vectors: bootstrap centroids and Gaussian satellites, and what they show of the producers.

A block of draws of one producer is a row; a task turns it into draw x run counts, and these
times the run x width matrix into points, so that draws x runs x width numbers never exist.  The
numbers of a draw come from its own number, so any task, and SQL, draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparvane.operators.moments import block, enough
from sparvane.operators.stats import PRIME, draws

DRAWS, BLOCK, RIDGE, TILE = 10_000, 500, 1e-4, 4096
SEED, NORMAL_SEED = 42, 43


def mixed(b: np.ndarray, slots: int, seed: int, stream: int = 0) -> np.ndarray:
    """Draw x slot numbers below PRIME: those of :func:`sparvane.operators.stats.draws`."""
    def power(x: np.ndarray) -> np.ndarray:
        square = x * x % PRIME
        return square * square % PRIME * x % PRIME

    first = (b[:, None] * 48271 + np.arange(slots) * 69621 + stream * 40692 + seed * 16807 + 1) % PRIME
    return power((power(first) * 48271 + 11) % PRIME)


def normals(b: np.ndarray, width: int, seed: int = NORMAL_SEED) -> np.ndarray:
    """Draw x width standard normal numbers by Box and Muller's transform of two numbers each."""
    u = (mixed(b, 2 * width, seed) + 0.5) / PRIME
    return np.sqrt(-2 * np.log(u[:, ::2])) * np.cos(2 * np.pi * u[:, 1::2])


def normal_numbers(spark, iterations: int, width: int, seed: int = NORMAL_SEED) -> DataFrame:
    """``b, d, z``: standard normal numbers as columns, the same as :func:`normals`."""
    slots = spark.range(2 * width).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("k"), F.lit(PRIME).cast("bigint").alias("n"))
    pairs = draws(iterations, slots, seed).groupBy("b", F.floor(F.col("k") / 2).alias("d")).agg(*(F.max(F.when(F.col("k") % 2 == j, F.col("i"))).alias(f"i{j}") for j in (0, 1)))
    u = [(F.col(c) + 0.5) / PRIME for c in ("i0", "i1")]
    return pairs.select("b", "d", (F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1])).alias("z"))


def bootstrap_points(runs: np.ndarray, b: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A centroid of resampled runs for each draw."""
    n = len(runs)
    chosen = mixed(b, n, seed) % n
    counts = np.zeros((len(b), n))
    np.add.at(counts, (np.arange(len(b))[:, None], chosen), 1.0)
    return counts @ runs / n


def satellite_model(runs: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Mean and factor (components x width) of the Gaussian about some runs: points are mean + z times the factor.

    With as many columns as runs or more, the Gaussian lies in the space of the standardised
    runs' principal components that explain ``share``, and points stay standardised.
    """
    n, width = runs.shape
    if width < n:
        cov = np.atleast_2d(np.cov(runs, rowvar=False)) if n > 1 else np.eye(width) * 1e-6
        return runs.mean(axis=0), np.linalg.cholesky(cov + RIDGE * np.eye(width)).T
    spread = runs.std(axis=0)
    x = (runs - runs.mean(axis=0)) / np.where(spread == 0, 1.0, spread)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    sign = np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)] < 0, -1.0, 1.0)
    most = max(1, min(n - 1, width, 50))
    k = max(1, enough(s[:most] ** 2 / max((s**2).sum(), 1e-300), share, most))
    low = (u * s * sign)[:, :k]
    cov = np.atleast_2d(np.cov(low, rowvar=False)) if n > 1 else np.eye(k) * 1e-6
    return np.zeros(width), np.linalg.cholesky(cov + RIDGE * np.eye(k)).T @ (vt * sign[:, None])[:k]


def clouds(runs: DataFrame, vector: str, kind: str, iterations: int = DRAWS) -> DataFrame:
    """``agent, b, point``: ``iterations`` points a producer (``bootstrap`` or ``gaussian``) of ``agent, run`` and their vectors.

    A producer's runs are few (its design); producers and draws may be many.
    """
    agent = runs.schema["agent"].dataType.simpleString()
    each = runs.groupBy("agent").agg(F.sort_array(F.collect_list(F.struct("run", F.col(vector).cast("array<double>").alias("v")))).alias("runs"))
    work = each.select("agent", F.transform("runs", lambda r: r["v"]).alias("runs"), F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(BLOCK))).alias("start"))
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start in enumerate(batch.column("start").to_pylist()):
                vectors = np.array(batch.column("runs")[i].as_py(), float)
                b = np.arange(start, min(start + BLOCK, iterations))
                if kind == "bootstrap":
                    points = bootstrap_points(vectors, b)
                else:
                    mean, factor = satellite_model(vectors)
                    points = mean + normals(b, len(factor)) @ factor
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("agent")[i], len(b)), pa.array(b), pa.array(list(points), pa.list_(pa.float64()))], names=["agent", "b", "point"])

    return work.repartition(tasks, "agent", "start").mapInArrow(run, f"agent {agent}, b long, point array<double>")


def spread(points: DataFrame) -> DataFrame:
    """``agent, d, mean, sd, lo, hi`` of each coordinate of the clouds."""
    cells = points.select("agent", F.posexplode("point").alias("d", "x"))
    lo, hi = (F.percentile("x", F.lit(p)) for p in (0.025, 0.975))
    return cells.groupBy("agent", (F.col("d") + 1).alias("d")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), lo.alias("lo"), hi.alias("hi"))


def cloud_summary(points: DataFrame, iterations: int = DRAWS) -> DataFrame:
    """``agent, n_mc, mean_norm, mean_sd, ci95_lo_norm, ci95_hi_norm``."""
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    return spread(points).groupBy("agent").agg(F.lit(iterations).alias("n_mc"), norm("mean").alias("mean_norm"), F.avg("sd").alias("mean_sd"), norm("lo").alias("ci95_lo_norm"), norm("hi").alias("ci95_hi_norm"))


def centroid_distances(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """``agent, b, own, other``: how far each point is from its producer's centroid and from the nearest of another; ``centroids``: ``agent, centroid``.

    Points meet TILE centroids at a time, which are broadcast; what the tiles find is merged by minima.
    """
    agent = points.schema["agent"].dataType.simpleString()
    tiles = max(1, -(-centroids.count() // TILE))

    def against(tile: int) -> DataFrame:
        rows = centroids.filter(F.pmod(F.xxhash64("agent"), F.lit(tiles)) == tile).select("agent", "centroid").collect()  # TILE of them, or about as many
        shared = points.sparkSession.sparkContext.broadcast(([r["agent"] for r in rows], np.array([r["centroid"] for r in rows], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, centres = shared.value
            place = {a: i for i, a in enumerate(names)}
            for batch in batches:
                if not (batch.num_rows and names):
                    continue
                x = block(batch.column("point"))
                far = np.sqrt(np.maximum(0, np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)))
                own = np.array([place.get(a, -1) for a in batch.column("agent").to_pylist()])
                mine = np.where(own >= 0, far[np.arange(len(x)), own], np.nan)
                far[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
                other = far.min(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("agent"), batch.column("b"), pa.array(mine, from_pandas=True), pa.array(np.where(np.isinf(other), np.nan, other), from_pandas=True)], names=["agent", "b", "own", "other"])

        return points.mapInArrow(run, f"agent {agent}, b long, own double, other double")

    found = reduce(DataFrame.unionByName, map(against, range(tiles)))
    return found if tiles == 1 else found.groupBy("agent", "b").agg(F.min("own").alias("own"), F.min("other").alias("other"))


def cloud_errors(distances: DataFrame) -> DataFrame:
    """Per producer how far its points are from its centroid and which share is nearer to another's."""
    lo, hi = (F.percentile("own", F.lit(p)) for p in (0.025, 0.975))
    overlap = F.avg(F.when(F.col("other").isNotNull(), (F.col("other") < F.col("own")).cast("double")))
    return distances.groupBy("agent").agg(
        F.avg("own").alias("mean_satellite_distance"), F.coalesce(F.stddev_samp("own"), F.lit(0.0)).alias("sd_satellite_distance"), lo.alias("distance_ci95_lo"), hi.alias("distance_ci95_hi"),
        overlap.alias("nearest_centroid_overlap"), F.count("*").alias("n_satellites"),
    )


def evenly(b: str, total: int, most: int) -> Column:
    """Whether a draw is among ``most`` evenly spaced ones of 0..total-1, both ends included."""
    if most >= total:
        return F.lit(True)
    step = (total - 1) / (most - 1)
    near = F.floor(F.col(b) / step)
    hits = [(F.floor((near + j) * step) == F.col(b)) & (near + j < most - 1) for j in (0, 1, 2)]
    return reduce(Column.__or__, hits) | (F.col(b) == total - 1)
