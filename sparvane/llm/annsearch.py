"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of ``books`` codebooks, all of the full
dimension.  Codebooks start as k-means over residuals and are refined by least squares;
codes are found by a beam search that uses the Gram matrix of all codewords.  The index
holds codes and norms of the sums beside the vectors.  A query makes a table of its inner
products with all codewords, scores a block by sums of table entries over the stored
norms, keeps the best ``shortlist`` of the block and ranks these by the exact measure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparvane.llm import vectors as V
from sparvane.llm.common import cut_lineage


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds, in expectation, the vectors that the codebooks are fitted on; all are indexed."""

    books: int = 8
    words: int = 256
    beam: int = 4
    sample: int = 4096
    steps: int = 6
    rounds: int = 2
    shortlist: int = 256
    seed: int = 7


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dim

    def __post_init__(self) -> None:
        flat = self.words.reshape(-1, self.words.shape[-1])
        self.flat, self.gram = flat, flat @ flat.T

    def encode(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x books) of least squared error that the beam finds, and the sums' norms."""
        parts = [self._encode(vectors[i : i + 512], beam) for i in range(0, len(vectors), 512)]
        codes = np.concatenate([p for p in parts]) if parts else np.zeros((0, len(self.words)), np.uint8)
        return codes, np.linalg.norm(self.decode(codes), axis=1)

    def _encode(self, vectors: np.ndarray, beam: int) -> np.ndarray:
        n, (books, words, _) = len(vectors), self.words.shape
        table, own = vectors @ self.flat.T, np.diag(self.gram)
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for book in range(books):
            part = slice(book * words, (book + 1) * words)
            step = cost[:, :, None] + (own[part] - 2 * table[:, part])[:, None, :]
            for earlier in range(book):
                step += 2 * self.gram[:, part][codes[:, :, earlier] + earlier * words]
            step = step.reshape(n, -1)
            keep = min(beam, step.shape[1])
            at = np.argpartition(step, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(step, at, 1)
            codes = np.concatenate([np.take_along_axis(codes, (at // words)[:, :, None], 1), (at % words)[:, :, None]], axis=2)
        return codes[np.arange(n), cost.argmin(1)].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[b][codes[:, b]] for b in range(len(self.words))) if len(codes) else np.zeros((0, self.words.shape[-1]), np.float32)


def _kmeans(points: np.ndarray, words: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), words, replace=len(points) < words)].copy()
    for _ in range(steps):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=words)
        np.add.at(sums, near, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def fit(points: np.ndarray, settings: Settings) -> Codebooks:
    """Residual k-means, then rounds of beam encoding and ridge least squares on what is left over."""
    rng, points = np.random.default_rng(settings.seed), points.astype(np.float32)
    words, rest = np.zeros((settings.books, settings.words, points.shape[1]), np.float32), points.copy()
    for book in words:
        book[:] = _kmeans(rest, settings.words, settings.steps, rng)
        rest -= book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
    books = Codebooks(words)
    for _ in range(settings.rounds):
        codes, _ = books.encode(points, settings.beam)
        used = np.zeros((len(points), settings.books * settings.words), np.float32)
        used[np.arange(len(points))[:, None], codes + np.arange(settings.books) * settings.words] = 1
        left = points - books.decode(codes)
        change = np.linalg.solve(used.T @ used + 2 * np.eye(used.shape[1], dtype=np.float32), used.T @ left)
        books = Codebooks(books.words + change.reshape(words.shape))
    return books


def _unit(block: np.ndarray) -> np.ndarray:
    largest = np.abs(block).max(1, keepdims=True)
    scaled = block / largest
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def build_index(table: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, dict[int, Codebooks]]:
    """Blocks ``dim, grp, ids, vectors, more`` (codes, then norms as float32) of every usable vector, and codebooks by dimension."""
    rows = V.clean(table, nonzero=True)
    books: dict[int, Codebooks] = {}
    for dim, total in rows.groupBy("dim").count().collect():
        share = min(1.0, settings.sample / total)
        chosen = rows.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20))) if share < 1 else rows.filter(F.col("dim") == dim)
        picked = chosen.select("vec_id", "embedding").toArrow().sort_by("vec_id").column("embedding").combine_chunks()
        points = V.matrix(picked, dim) if len(picked) else np.ones((1, dim))
        books[dim] = fit(_unit(points), settings)
    shared = table.sparkSession.sparkContext.broadcast({d: b.words for d, b in books.items()})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Codebooks] = {}
        for dim, grp, ids, block in V.packed(batches):
            if dim not in ready:
                ready[dim] = Codebooks(shared.value[dim])
            codes, norms = ready[dim].encode(_unit(block), settings.beam)
            out = [dim], [grp], [ids.tobytes()], [block.tobytes()], [codes.tobytes() + norms.astype(np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), *[pa.binary()] * 3))], names=["dim", "grp", "ids", "vectors", "more"])

    return cut_lineage(rows.mapInArrow(index, "dim int, grp int, ids binary, vectors binary, more binary")), books


def search(index: DataFrame, books: dict[int, Codebooks], queries: DataFrame, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score`` (cosine in double precision) of each query's k nearest found."""
    tiles = V.Tiles.write(V.clean(queries, nonzero=True))
    shared = queries.sparkSession.sparkContext.broadcast({d: b.words for d, b in books.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, grp = batch.column("dim")[i].as_py(), batch.column("grp")[i].as_py()
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                block = np.frombuffer(batch.column("vectors")[i].as_buffer(), np.float64).reshape(len(ids), dim)
                words = shared.value[dim]
                packed = batch.column("more")[i].as_py()
                codes = np.frombuffer(packed, np.uint8, len(ids) * len(words)).reshape(len(ids), -1)
                norms = np.frombuffer(packed, np.float32, offset=codes.size)
                size, lengths = np.maximum(norms, 1e-12), _norms(block)
                for query_ids, vectors in tiles.of(dim):
                    yield V.lists(grp, _found(ids, block, codes, size, lengths, words, query_ids, vectors, k, settings))

    return V.merge(index.mapInArrow(score, "query_id long, grp int, vec_id long, score double"), k)


def _found(ids: np.ndarray, block: np.ndarray, codes: np.ndarray, size: np.ndarray, lengths: np.ndarray, words: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, k: int, settings: Settings) -> list[tuple[np.ndarray, ...]]:
    """For each query of a tile its best k of a block: shortlisted by table sums over the stored norms, ranked exactly."""
    units, found = _unit(vectors), []
    for start in range(0, len(query_ids), 64):
        table = np.einsum("qd,bwd->bqw", units[start : start + 64], words, optimize=True)
        near = table[0][:, codes[:, 0]]
        for book in range(1, len(words)):
            near += table[book][:, codes[:, book]]
        near /= size
        for j, query in enumerate(query_ids[start : start + 64].tolist()):
            near[j][ids == query] = -np.inf
            at = np.sort(V.best(near[j], settings.shortlist))
            at = at[ids[at] != query]
            vector = vectors[start + j]
            exact = (block[at] / lengths[at, None] * (vector / _norms(vector[None])[0])).sum(1)
            top = V.best(exact, k)
            found.append((np.full(len(top), query), ids[at[top]], exact[top]))
    return found


def _norms(block: np.ndarray) -> np.ndarray:
    """Euclidean lengths without overflow."""
    largest = np.abs(block).max(1)
    return largest * np.sqrt(((block / largest[:, None]) ** 2).sum(1))


def nearest(table: DataFrame, is_query: Column, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """Each query row's k nearest other rows by cosine, ties to the smaller id.

    A query meets every row but those with its own id; a query id that several rows share
    is asked once.  Null and zero vectors, vectors with null or non-finite components and
    rows without id take no part; only vectors of equal length are compared; other
    columns are ignored; an empty table gives no rows.
    """
    index, books = build_index(table, settings)
    return search(index, books, table.filter(is_query), k, settings)
