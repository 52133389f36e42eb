"""Layouts of runs in a plane by their distances: stress majorisation, stochastic neighbours, and a graph of nearest neighbours.

All pairs' distances lie in strips, a block of rows against all columns each, written once.  A
round sends the positions (runs x 2 numbers) to the strips and gets new positions or gradients of
each strip's rows; the driver only adds them up and moves the positions.  Distances are of all
pairs, so more than MOST items are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.operators.moments import Axes, moments
from sparvane.operators.montecarlo import mixed, normals
from sparvane.operators.settled import settled

MOST, STRIP = 20_000, 256
SCHEMA = "start int, data binary"


def _batch(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes() for _, x in rows], pa.binary())], names=["start", "data"])


class Strips:
    """``start, data``: rows start.. of an n x n matrix."""

    def __init__(self, rows: DataFrame, n: int) -> None:
        self.rows, self.n = rows, n

    def map(self, work: Callable[[int, np.ndarray], list[tuple[int, np.ndarray]]]) -> DataFrame:
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                    yield _batch(work(start, np.frombuffer(data.as_buffer()).reshape(-1, n)))

        return self.rows.mapInArrow(run, SCHEMA)

    def gather(self, work: Callable[[int, np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """``width`` numbers for each of the n rows."""
        found = self.map(lambda start, x: [(start, work(start, x))]).collect()  # n x width numbers
        return np.concatenate([np.frombuffer(r["data"]).reshape(-1, width) for r in sorted(found, key=lambda r: r["start"])])


def distances(items: DataFrame, keys: list[str], vector: str) -> tuple[Strips, list[tuple]]:
    """Euclidean distances of the standardised vectors (constant columns count as 0), and the items' keys in their order."""
    spark, m = items.sparkSession, moments(items, vector)
    n = m.n if m else 0
    if n > MOST:
        raise ValueError(f"{n} items: a layout of all pairs takes {MOST} at most")
    rows = items.select(*keys, vector).orderBy(*keys).collect()  # MOST at most
    if not n:
        return Strips(spark.createDataFrame([], SCHEMA), 0), []
    scale = Axes.fit(m, 1, scaled=True)
    shared = spark.sparkContext.broadcast((np.array([r[vector] for r in rows], float) - scale.mean) / scale.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        for batch in batches:
            for start in batch.column("id").to_pylist():
                own = z[start : start + STRIP]
                yield _batch([(start, np.sqrt(np.stack([((z - x) ** 2).sum(axis=1) for x in own])))])

    starts = spark.range(0, n, STRIP, numPartitions=-(-n // STRIP))
    return Strips(settled(starts.mapInArrow(run, SCHEMA)), n), [tuple(r[k] for k in keys) for r in rows]


def start_positions(n: int, spread: float, seed: int) -> np.ndarray:
    return normals(np.arange(n), 2, seed) * spread


def apart(start: int, rows: int, at: np.ndarray) -> np.ndarray:
    """rows x n x 2 differences of positions."""
    return at[start : start + rows, None, :] - at[None, :, :]


def majorise(far: Strips, rounds: int = 300, least: float = 1e-6, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """Positions of metric scaling by Guttman's transform, and the stress (sum of squared errors over pairs) before each round; stops if it falls by less than ``least`` of itself."""
    spark, at, stress = far.rows.sparkSession, start_positions(far.n, 1.0, seed), []
    for _ in range(rounds if far.n > 1 else 0):
        shared = spark.sparkContext.broadcast(at)

        def step(start: int, wanted: np.ndarray) -> np.ndarray:
            away = apart(start, len(wanted), shared.value)
            now = np.sqrt((away**2).sum(axis=2))
            ratio = np.divide(wanted, now, out=np.zeros_like(now), where=now > 0)
            return np.c_[(ratio[:, :, None] * away).sum(axis=1) / len(shared.value), ((now - wanted) ** 2).sum(axis=1)]

        found = far.gather(step, 3)
        stress.append(float(found[:, 2].sum() / 2))
        shared.unpersist()
        if len(stress) > 1 and stress[-2] - stress[-1] <= least * stress[-2]:
            break
        at = found[:, :2]
    return at, stress


def neighbours(start: int, far: np.ndarray, perplexity: float) -> np.ndarray:
    """Each row's chances of the others under a Gaussian whose width gives it that perplexity, found by bisection."""
    square, own = far**2, np.arange(start, start + len(far))
    square[np.arange(len(far)), own] = np.inf
    square = square - square.min(axis=1, keepdims=True)
    low, high, beta = np.zeros(len(far)), np.full(len(far), np.inf), np.ones(len(far))
    for _ in range(64):  # for all rows alike, so that strips make no difference
        p = np.exp(-square * beta[:, None])
        p /= p.sum(axis=1, keepdims=True)
        entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p


def affinities(far: Strips, perplexity: float) -> Strips:
    """The symmetric chances of pairs: (p + p') / 2n, whose strips meet their transposed pieces in one shuffle."""
    n = far.n

    def pieces(start: int, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        p = neighbours(start, x, perplexity) / (2 * n)
        turned = [(to, np.r_[float(start), p[:, to : to + STRIP].T.ravel()]) for to in range(0, n, STRIP)]
        return [(start, np.r_[-1.0, p.ravel()]), *turned]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips: dict[int, np.ndarray] = {}
        for batch in batches:
            for to, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                first, *_ = flat = np.frombuffer(data.as_buffer())
                rows = min(STRIP, n - to)
                strip = strips.setdefault(to, np.zeros((rows, n)))
                part = flat[1:].reshape(rows, -1)
                at = 0 if first < 0 else int(first)
                strip[:, at : at + part.shape[1]] += part
        yield _batch(sorted(strips.items()))

    tasks = max(1, -(-n // STRIP))
    return Strips(settled(far.map(pieces).repartition(tasks, "start").mapInArrow(add, SCHEMA)), n)


def stochastic_neighbours(far: Strips, rounds: int = 1000, early: int = 250, perplexity: float = 5.0, seed: int = 42) -> tuple[np.ndarray, list[float]] | None:
    """Positions of t-distributed stochastic neighbour embedding, and the divergence before each round; None of fewer than four items.

    The perplexity is (n - 1) / 3 at most, 1 at least.  Pairs attract each other twelve times
    as much in the ``early`` rounds; then momentum grows from 0.5 to 0.8.
    """
    n = far.n
    if n < 4:
        return None
    spark, pairs = far.rows.sparkSession, affinities(far, max(1.0, min(perplexity, (n - 1) / 3)))
    at, speed, gains, divergence = start_positions(n, 1e-4, seed), np.zeros((n, 2)), np.ones((n, 2)), []
    rate = max(n / 12 / 4, 50)
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(at)

        def step(start: int, p: np.ndarray) -> np.ndarray:
            away = apart(start, len(p), shared.value)
            q = 1 / (1 + (away**2).sum(axis=2))
            q[np.arange(len(p)), np.arange(start, start + len(p))] = 0
            pull, push = ((w[:, :, None] * away).sum(axis=1) for w in (p * q, q * q))
            cost = np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / np.where(q > 0, q, 1)), 0).sum(axis=1)
            return np.c_[pull, push, q.sum(axis=1), cost, p.sum(axis=1)]

        found = pairs.gather(step, 7)
        shared.unpersist()
        total = found[:, 4].sum()
        divergence.append(float(found[:, 5].sum() + found[:, 6].sum() * np.log(total)))
        gradient = 4 * ((12 if number < early else 1) * found[:, :2] - found[:, 2:4] / total)
        gains = np.maximum(np.where(speed * gradient < 0, gains + 0.2, gains * 0.8), 0.01)
        speed = (0.5 if number < early else 0.8) * speed - rate * gains * gradient
        at = at + speed
    return at - at.mean(axis=0), divergence


def memberships(start: int, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its k - 1 nearest others and how far they belong to it: 1 up to the nearest, then falling so that they add up to log2(k) at most."""
    far = far.copy()
    far[np.arange(len(far)), np.arange(start, start + len(far))] = np.inf
    at = np.argsort(far, axis=1, kind="stable")[:, : k - 1]
    d = np.take_along_axis(far, at, axis=1)
    beyond = np.maximum(0, d - np.where(d > 0, d, np.inf).min(axis=1, keepdims=True))
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        wide = np.exp(-beyond / sigma[:, None]).sum(axis=1) > np.log2(k)
        low, high = np.where(wide, low, sigma), np.where(wide, sigma, high)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    floor = 1e-3 * d.mean(axis=1)  # of equal distances
    return at, np.exp(-beyond / np.maximum(np.maximum(sigma, floor), 1e-300)[:, None])


def neighbour_graph(far: Strips, k: int = 5) -> DataFrame:
    """``i, to, w``: each item's neighbours in the fuzzy union of all items' memberships (w + w' - w w'), both directions of an edge."""
    k = min(k, far.n - 1) if far.n > 1 else 1

    def near(start: int, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        at, w = memberships(start, x, max(k, 2))
        return [(start + i, np.r_[a.astype(float), b]) for i, (a, b) in enumerate(zip(at, w))]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *np.frombuffer(d.as_buffer()).reshape(2, -1)) for i, d in zip(batch.column("start").to_pylist(), batch.column("data"))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], pa.int32()), pa.array([list(map(int, a)) for _, a, _ in rows], pa.list_(pa.int32())), pa.array([list(w) for *_, w in rows], pa.list_(pa.float64()))], names=["i", "to", "w"])

    one = far.map(near).mapInArrow(listed, "i int, to array<int>, w array<double>").select("i", F.inline(F.arrays_zip("to", "w")))
    both = one.unionByName(one.select(F.col("to").alias("i"), F.col("i").alias("to"), "w")).filter("w > 0")
    edges = both.groupBy("i", "to").agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))
    return edges


# The curve 1 / (1 + a d**2b) of a least distance of 0.1.
CURVE_A, CURVE_B = 1.576943460405378, 0.8950608781227859


def graph_layout(edges: DataFrame, n: int, rounds: int = 200, samples: int = 5, seed: int = 42) -> np.ndarray:
    """Positions in which neighbours attract each other by their weight and ``samples`` others a neighbour, drawn by number, repel; steps shrink to nothing."""
    spark, at = edges.sparkSession, start_positions(n, 3.0, seed)
    lists = edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("to", "w"))).alias("e"))
    lists = settled(lists.select("i", F.transform("e", lambda x: x["to"]).alias("to"), F.transform("e", lambda x: x["w"]).alias("w")))
    for number in range(rounds if n > 1 else 0):
        shared = spark.sparkContext.broadcast(at)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = shared.value
            for batch in batches:
                own, sizes = batch.column("i").to_numpy(), np.diff(batch.column("to").offsets.to_numpy())
                here = np.repeat(np.arange(len(own)), sizes)
                away = y[own[here]] - y[batch.column("to").flatten().to_numpy()]
                square = (away**2).sum(axis=1)
                w = batch.column("w").flatten().to_numpy()
                pull = np.where(square > 0, -2 * CURVE_A * CURVE_B * np.maximum(square, 1e-300) ** (CURVE_B - 1) / (1 + CURVE_A * square**CURVE_B), 0)
                out = np.zeros((len(own), 2))
                np.add.at(out, here, w[:, None] * np.clip(pull[:, None] * away, -4, 4))
                other = mixed(np.arange(number * n, number * n + 1) + own, samples, seed + 1) % n if len(own) else np.zeros((0, samples), int)
                away = y[own][:, None] - y[other]
                square = (away**2).sum(axis=2)
                push = np.where(other != own[:, None], 2 * CURVE_B / ((0.001 + square) * (1 + CURVE_A * square**CURVE_B)), 0)
                total = np.zeros(len(own))
                np.add.at(total, here, w)
                out += total[:, None] * np.clip(push[:, :, None] * away, -4, 4).sum(axis=1)
                yield _batch(list(zip(own.tolist(), out)))

        moved = np.zeros((n, 2))
        for r in lists.mapInArrow(step, SCHEMA).collect():  # n x 2 numbers
            moved[r["start"]] = np.frombuffer(r["data"])
        shared.unpersist()
        at = at + 0.5 * (1 - number / rounds) * moved
    return at - at.mean(axis=0) if n else at


def placed(spark: SparkSession, keys: list[tuple], at: np.ndarray, schema: str) -> DataFrame:
    return spark.createDataFrame([(*k, *map(float, x)) for k, x in zip(keys, at)], schema)
