"""One- and two-word terms of texts, counted where the texts lie: only sums by term are shuffled, and only of terms that can be among the frequent ones.

The frequent terms are found in two passes.  The first adds up the terms' counts in two
tables of cells, by two parts of a term's 64-bit key; a cell's sum is no less than the count of
any term in it.  The second counts exactly the terms whose two cells both reach a limit.  If
the wanted number of terms reach the limit, no other term can; otherwise the limit is halved
and they are counted again, at last all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"
CELL_BITS, BLOCK = 20, 1 << 14
SPAN = 1 << 19


def words(text: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def worded(rows: DataFrame) -> DataFrame:
    """``id, words, codes`` of ``id, text``, one row an id; where ids repeat, a null stands between the texts' words."""
    out = rows.select("id", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        apart = F.array(F.lit(None).cast("string"))
        out = out.groupBy("id").agg(F.flatten(F.collect_list(F.concat("words", apart))).alias("words"))
    return out.withColumn("codes", F.transform("words", lambda w: F.when(w.isNotNull(), F.xxhash64(w))))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of two neighbouring words."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class _Piece:
    """Some rows of a batch with the keys of all their terms: whose each is, at which word it begins, and how many are of one word."""

    rows: pa.RecordBatch
    keys: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    single: int


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("codes").offsets.to_numpy()))
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SPAN, "right")))
            part = batch.slice(first, last - first)
            codes = part.column("codes")
            flat = codes.flatten()
            known = np.asarray(flat.is_valid())
            code = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            owner = np.repeat(np.arange(part.num_rows), np.diff(codes.offsets.to_numpy()))
            one = np.flatnonzero(known)
            two = np.flatnonzero(known[:-1] & known[1:] & (owner[:-1] == owner[1:]))
            at = np.concatenate([one, two])
            yield _Piece(part, np.concatenate([code[one], _pair(code[two], code[two + 1])]), owner[at], at, len(one))
            first = last


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), (keys >> np.uint64(64 - bits)).astype(np.int64)


def _bounds(texts: DataFrame, bits: int) -> np.ndarray:
    """Sums of counts by cell of both tables (2 x 2 ** bits numbers, whatever the input)."""
    size = 1 << bits
    width = min(BLOCK, size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for piece in _pieces(batches):
            for row, cells in zip(total, _cells(piece.keys, bits)):
                row += np.bincount(cells, minlength=size)
        flat = total.reshape(-1, width)
        some = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([flat[i].tobytes() for i in some], pa.binary())], names=["block", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                found[block] = found.get(block, 0) + np.frombuffer(data, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["block", "data"])

    out = np.zeros((2 * size // width, width), np.int64)
    parts = texts.select("codes").mapInArrow(sums, "block int, data binary").repartition(16, "block").mapInArrow(added, "block int, data binary")
    for r in parts.toLocalIterator():
        out[r.block] = np.frombuffer(r.data, np.int64)
    return out.reshape(2, size)


def _counted(texts: DataFrame, reached: np.ndarray, bits: int) -> DataFrame:
    """``term, total, df`` of the terms whose cells have both ``reached`` the limit."""
    shared = texts.sparkSession.sparkContext.broadcast(reached)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            a, b = _cells(piece.keys, bits)
            kept = np.flatnonzero(shared.value[0][a] & shared.value[1][b])
            _, first, which, total = np.unique(piece.keys[kept], return_index=True, return_inverse=True, return_counts=True)
            texts_of = np.unique(which.astype(np.int64) * piece.rows.num_rows + piece.owner[kept]) // piece.rows.num_rows
            word, at, two = piece.rows.column("words").flatten(), piece.at[kept][first], kept[first] >= piece.single
            names = word.take(pa.array(at))
            pairs = pc.binary_join_element_wise(word.take(pa.array(at[two])), word.take(pa.array(at[two] + 1)), " ")
            names = pa.concat_arrays([names.filter(pa.array(~two)), pairs.cast(names.type)])
            order = np.concatenate([np.flatnonzero(~two), np.flatnonzero(two)])
            yield pa.RecordBatch.from_arrays([names, pa.array(total[order], pa.int64()), pa.array(np.bincount(texts_of, minlength=len(total))[order], pa.int64())], names=["term", "total", "df"])

    return texts.select("words", "codes").mapInArrow(run, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def frequent(texts: DataFrame, most: int, bits: int = CELL_BITS) -> list[tuple[str, int]]:
    """The ``most`` frequent terms of :func:`worded` texts (of equal ones the first) by name, each with the number of texts that have it."""
    bounds = _bounds(texts, bits)
    least = np.partition(bounds[0], -most)[-most] if most < bounds.shape[1] else 0
    limit = max(1, int(0.9 * (least - np.median(bounds[0]))))
    while True:
        top = _counted(texts, bounds >= limit, bits).orderBy(F.desc("total"), "term").limit(most).collect()
        if limit == 1 or len(top) == most and top[-1].total >= limit:
            return sorted((r.term, r.df) for r in top)
        limit //= 2


def weighed(texts: DataFrame, names: list[str], idf: list[float]) -> DataFrame:
    """``id, at, w`` of every :func:`worded` text: the numbers of the terms that it has, and their weights (1 + ln tf) idf, of length 1 in all."""
    spark: SparkSession = texts.sparkSession
    codes = F.transform(F.split("term", " "), lambda w: F.xxhash64(w))
    known = spark.createDataFrame(pd.DataFrame({"n": np.arange(len(names)), "term": pd.Series(names, dtype=object)}), "n int, term string").select("n", codes.alias("c")).orderBy("n").collect()
    word = lambda i: np.array([r.c[min(i, len(r.c) - 1)] for r in known], np.int64).view(np.uint64)
    keys = np.where(np.array([len(r.c) == 1 for r in known], bool), word(0), _pair(word(0), word(1)))
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], order, np.array(idf, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number, idf = shared.value
        for piece in _pieces(batches):
            n = piece.rows.num_rows
            place = np.searchsorted(keys, piece.keys)
            place[place == len(keys)] = 0
            hit = np.flatnonzero(keys[place] == piece.keys) if len(keys) else np.zeros(0, np.int64)
            found, tf = np.unique(piece.owner[hit] * max(len(keys), 1) + number[place[hit]], return_counts=True)
            row, at = np.divmod(found, max(len(keys), 1))
            w = (1 + np.log(tf)) * idf[at]
            w /= np.sqrt(np.bincount(row, w * w, n))[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
            yield pa.RecordBatch.from_arrays([piece.rows.column("id"), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w, pa.float64()))], names=["id", "at", "w"])

    return texts.select("id", "codes").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, at array<int>, w array<double>")
