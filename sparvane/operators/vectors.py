"""Text vectors without a trained model: TF-IDF of one- and two-word terms, reduced by a singular value decomposition; and reductions of run vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.operators import terms as W
from sparvane.operators.moments import Axes, enough, moments, project  # noqa: F401
from sparvane.operators.stats import mean_vector

TERMS, COMPONENTS, BLOCK = 20_000, 128, 500
WORD = W.WORD


def terms(text: Column) -> Column:
    """Lower-case words of two characters or more, then neighbouring pairs of them."""
    words = W.words(text)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(words, F.array_compact(pairs))


def inverse_frequencies(texts: DataFrame, most: int, n: int) -> tuple[list[str], list[float]]:
    """The ``most`` frequent terms of worded texts by name, and 1 + ln((1 + n) / (1 + df)) of each."""
    top = W.frequent(texts, most)
    return [t for t, _ in top], [math.log((1 + n) / (1 + df)) + 1 for _, df in top]


def sparse_tfidf(rows: DataFrame, most: int = TERMS) -> tuple[DataFrame, list[str]]:
    """``id, at, w`` arrays of :func:`tfidf`'s weights, and the terms by their number; no text is shuffled."""
    texts = W.worded(rows)
    names, idf = inverse_frequencies(texts, most, rows.count())
    return W.weighed(texts, names, idf).filter(F.size("at") > 0), names


def named(names: list[str], spark: SparkSession) -> DataFrame:
    """``at, term``: names by their number (``TERMS`` at most)."""
    return F.broadcast(spark.createDataFrame(pd.DataFrame({"at": np.arange(len(names)), "term": pd.Series(names, dtype=object)}), "at int, term string"))


def tfidf(rows: DataFrame, most: int = TERMS) -> DataFrame:
    """``id, term, w`` of ``id, text``: (1 + ln tf) (1 + ln((1 + n) / (1 + df))) over the ``most`` frequent terms, each text's weights of length 1."""
    found, names = sparse_tfidf(rows, most)
    return found.select("id", F.inline(F.arrays_zip("at", "w"))).join(named(names, rows.sparkSession), "at").select("id", "term", "w")


def sparse_rows(weights: DataFrame) -> tuple[DataFrame, list[str]]:
    """``id, at, w`` arrays of ``id, term, w``, and the terms by their number (TERMS at most)."""
    names = [r.term for r in weights.select("term").distinct().orderBy("term").collect()]
    spark = weights.sparkSession
    numbers = spark.createDataFrame(pd.DataFrame({"term": names, "n": np.arange(len(names))}), "term string, n int")
    return numbered_rows(weights.join(F.broadcast(numbers), "term")), names


def numbered_rows(weights: DataFrame) -> DataFrame:
    """``id, at, w`` arrays of ``id, n, w`` with the terms' numbers."""
    rows = weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("row"))
    return rows.select("id", F.transform("row", lambda r: r.n).alias("at"), F.transform("row", lambda r: r.w).alias("w"))


ENTRIES, ROWS = 16_384, 64


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Sparse rows some at a time (about ENTRIES entries, ROWS rows at most): which rows, the terms they have, and their weights as a dense matrix."""
    at, w = (batch.column(c).flatten().to_numpy() for c in ("at", "w"))
    ends = np.cumsum(np.diff(batch.column("at").offsets.to_numpy()))
    first = 0
    while first < len(ends):
        begin = int(ends[first - 1]) if first else 0
        last = min(first + ROWS, max(first + 1, int(np.searchsorted(ends, begin + ENTRIES, "right"))))
        stop = int(ends[last - 1])
        terms, column = np.unique(at[begin:stop], return_inverse=True)
        dense = np.zeros((last - first, len(terms)))
        dense[np.searchsorted(ends, np.arange(begin, stop), "right") - first, column] = w[begin:stop]
        yield slice(first, last), terms, dense
        first = last


def _times(batch: pa.RecordBatch, basis: np.ndarray) -> np.ndarray:
    """Rows times the basis."""
    out = np.zeros((batch.num_rows, basis.shape[1]))
    for rows, terms, dense in _pieces(batch):
        out[rows] = dense @ basis[terms]
    return out


def fit_components(rows: DataFrame, width: int, components: int = COMPONENTS, rounds: int = 6, seed: int = 42) -> np.ndarray:
    """The leading right singular vectors (width x components) of sparse rows, by subspace iteration.

    A round multiplies every row by the basis where it lies and adds up the products by
    blocks of terms; the driver sees width x (components + 10) numbers a round, whatever the
    number of rows.
    """
    spark = rows.sparkSession
    n = rows.count()
    k = max(1, min(components, width - 1, n - 1))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + 10))))[0]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(basis)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(shared.value.shape), 0
            for batch in batches:
                for _, terms, dense in _pieces(batch):
                    total[terms] += dense.T @ (dense @ shared.value[terms])
                seen += batch.num_rows
            starts = [s for s in range(0, len(total) if seen else 0, BLOCK) if total[s : s + BLOCK].any()]  # blocks of terms that this task's rows have
            yield pa.RecordBatch.from_arrays([pa.array([s // BLOCK for s in starts], pa.int32()), pa.array([total[s : s + BLOCK].tobytes() for s in starts], pa.binary())], names=["block", "data"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                    part = np.frombuffer(data)
                    sums[block] = sums[block] + part if block in sums else part
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

        blocks = -(-width // BLOCK)
        parts = rows.mapInArrow(products, "block int, data binary").repartitionById(blocks, F.col("block")).mapInArrow(added, "block int, data binary").collect()
        image = np.zeros(basis.shape)
        for r in parts:
            image[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.data).reshape(-1, basis.shape[1])
        shared.unpersist()
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        found = basis @ turn[:, ::-1][:, :k]
        basis = np.linalg.qr(image)[0]
    return found


def embed(rows: DataFrame, components: np.ndarray) -> DataFrame:
    """``id, embedding``: rows times the components, of length 1 (zero rows stay zero)."""
    shared = rows.sparkSession.sparkContext.broadcast(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _times(batch, shared.value)
            size = np.linalg.norm(out, axis=1, keepdims=True)
            unit = (out / np.where(size == 0, 1, size)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(unit), pa.list_(pa.float32()))], names=["id", "embedding"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<float>")


def pooled(rows: DataFrame, levels: list[list[str]], vector: str = "embedding") -> DataFrame:
    """Means of means: each level of keys averages the one before, unweighted."""
    for keys in levels:
        rows = mean_vector(rows, keys, vector)
    return rows


def mean_of_few(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Like a level of :func:`pooled`, for groups of a few rows: whole vectors are shuffled, not a row for each of their numbers."""
    few = rows.groupBy(*keys).agg(F.collect_list(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    total = F.aggregate("v", F.transform(F.get("v", F.lit(0)), lambda x: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return few.select(*keys, F.transform(total, lambda x: x / F.size("v")).alias(vector))


def principal(matrix: np.ndarray, components: int, scaled: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and explained shares of the leading principal components; of standardised columns, if ``scaled`` (constant ones count as 0).

    The largest weight of each component is positive.
    """
    x = matrix - matrix.mean(axis=0)
    if scaled:
        spread = matrix.std(axis=0)
        x = x / np.where(spread == 0, 1.0, spread)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    k = min(components, *matrix.shape)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    share = s**2 / max((s**2).sum(), 1e-300)
    return (u * s * sign)[:, :k], share[:k]


def run_components(runs: DataFrame, vector: str, components: int = 3, scaled: bool = True) -> DataFrame:
    """``agent, run, pc, x, explained``: principal components of run vectors, from their moments."""
    m = moments(runs, vector)
    kinds = [runs.select(c).schema[c].dataType.simpleString() for c in ("agent", "run")]
    if m is None:
        return runs.sparkSession.createDataFrame([], f"agent {kinds[0]}, run {kinds[1]}, pc int, x double, explained double")
    axes = Axes.fit(m, components, scaled)
    shares = F.array(*(F.lit(float(x)) for x in axes.shares))
    placed = project(runs.select("agent", "run", vector), vector, axes).select("agent", "run", F.posexplode("coordinates").alias("at", "x"))
    return placed.select("agent", "run", (F.col("at") + 1).alias("pc"), "x", F.get(shares, F.col("at")).alias("explained"))


def partial_least_squares(x: np.ndarray, y: np.ndarray, components: int = 2, rounds: int = 500) -> dict[str, np.ndarray]:
    """PLS of one response by NIPALS on centred data: scores, weights, loadings, the response's loadings and the coefficients."""
    left, rest = x - x.mean(axis=0), y - y.mean()
    scores, weights, loadings, of_y = [], [], [], []
    for _ in range(components):
        w = left.T @ rest
        size = np.linalg.norm(w)
        if size < 1e-12:
            break
        w = w / size
        t = left @ w
        p, q = left.T @ t / (t @ t), rest @ t / (t @ t)
        left, rest = left - np.outer(t, p), rest - t * q
        for kept, new in ((scores, t), (weights, w), (loadings, p), (of_y, q)):
            kept.append(new)
    t, w, p, q = np.array(scores).T, np.array(weights).T, np.array(loadings).T, np.array(of_y)
    return {"scores": t, "weights": w, "loadings": p, "of_y": q, "coefficients": w @ np.linalg.solve(p.T @ w, q) if len(q) else np.zeros(x.shape[1])}


def importance(model: dict[str, np.ndarray]) -> np.ndarray:
    """Variable importance in projection."""
    w, t, q = model["weights"], model["scores"], model["of_y"]
    explained = q**2 * (t**2).sum(axis=0)
    return np.sqrt(len(w) * (w**2 @ explained) / explained.sum()) if explained.sum() > 0 else np.zeros(len(w))


def discriminate(cells: DataFrame, components: int = 2) -> DataFrame:
    """``feature, vip, r2, q2`` of ``feature, sample, grp, v``: PLS of case against control, with leave-one-out prediction; one group (samples are few)."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="sample", columns="feature", values="v").fillna(0.0)
        y = (rows.groupby("sample").grp.first().reindex(table.index) == "case").to_numpy(float)
        x = table.to_numpy(float)
        k = max(1, min(components, len(x) - 1, x.shape[1]))
        fitted = lambda m, a, b, z: (z - a.mean(axis=0)) @ m["coefficients"] + b.mean()
        model = partial_least_squares(x, y, k)
        out = np.array([fitted(partial_least_squares(np.delete(x, i, 0), np.delete(y, i), k), np.delete(x, i, 0), np.delete(y, i), x[i]) for i in range(len(x))])
        total = ((y - y.mean()) ** 2).sum()
        share = lambda p: 1 - ((y - p) ** 2).sum() / total if total > 0 else None
        return pd.DataFrame({"feature": table.columns, "vip": importance(model), "r2": share(fitted(model, x, y, x)), "q2": share(out)})

    chosen = cells.select("feature", F.col("sample").cast("string").alias("sample"), "grp", "v", F.lit("samples").alias("__all"))
    return chosen.groupBy("__all").applyInPandas(work, "feature string, vip double, r2 double, q2 double")
