"""Exact top-k by inner product: tiles of queries times blocks of vectors.

A block meets each tile in matrix products; each query keeps its best k of the block, and
a tree of two levels merges these lists.  Vectors never leave the task that scans them.  Scores are integers: products run in double
precision while that is exact, else in 64-bit or unbounded integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from sparvane.llm import vectors as V


def _whole(block: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(block * scale)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T for whole numbers; beyond the range of a long the nearest long."""
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if bound < 2.0**53:
        return (left @ right.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    wide = exact(left) @ exact(right).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products.

    Components become ``floor(scale * x)``.  A query meets every row but those with its
    own id; ties go to the smaller id; rows of the same id rank one by one; a query id
    that several rows share is asked once.  Vectors that are null or hold null or
    non-finite components, and rows without id, take no part.  Only vectors of equal
    length are compared.  Other columns are ignored; an empty table gives no rows.
    """
    rows = V.clean(table)
    tiles = V.Tiles.write(rows.filter(is_query))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, grp, ids, block in V.packed(batches):
            block = _whole(block, scale)
            for query_ids, queries in tiles.of(dim):
                found: list[tuple[np.ndarray, ...]] = []
                for start in range(0, len(query_ids), 256):
                    part = slice(start, start + 256)
                    for query, scores in zip(query_ids[part].tolist(), _products(_whole(queries[part], scale), block)):
                        others = np.flatnonzero(ids != query)
                        at = others[V.best(scores[others], k)]
                        found.append((np.full(len(at), query), ids[at], scores[at]))
                yield V.lists(grp, found)

    return V.merge(rows.mapInArrow(score, "query_id long, grp int, vec_id long, score long"), k)
