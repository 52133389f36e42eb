"""Chunk embeddings in two phases: a backend is fitted on a whole corpus and kept in a folder, and encodes texts of any later frame.

``BACKENDS`` holds the ways to fit one by name.  Where a name isn't known, or the fallback is
forced, it is the weights of one- and two-word terms reduced by a singular value decomposition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.operators import terms as W
from sparvane.operators import vectors as V
from sparvane.operators.settled import settled


@dataclass
class TermModel:
    """Terms with their number and inverse frequency, and the components' weights of each (at most V.TERMS terms)."""

    name = "tfidf+svd"
    folder: str
    terms: DataFrame

    @staticmethod
    def fit(chunks: DataFrame, folder: str, most: int = V.TERMS, components: int = V.COMPONENTS) -> TermModel:
        """Fits ``id, text`` rows and writes the model to ``folder``; without ``components`` it has weights only."""
        spark = chunks.sparkSession
        texts = W.worded(chunks)
        names, idf = V.inverse_frequencies(texts, most, chunks.count())
        found = np.zeros((len(names), 0))
        if names and components:
            rows = W.weighed(texts, names, idf).filter(F.size("at") > 0)
            found = V.fit_components(settled(rows), len(names), components)  # read in each round
        table = spark.createDataFrame([(i, t, x, found[i].tolist()) for i, (t, x) in enumerate(zip(names, idf))], "n int, term string, idf double, components array<double>")
        table.write.mode("overwrite").parquet(folder)
        return TermModel.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> TermModel:
        return TermModel(folder, spark.read.parquet(folder))

    def sparse(self, texts: DataFrame) -> DataFrame:
        """``id, at, w`` of every id of ``id, text``: the numbers and weights of the model's terms in its text, empty without any."""
        known = self.terms.select("term", "idf").orderBy("n").collect()  # V.TERMS terms at most
        return W.weighed(W.worded(texts), [r["term"] for r in known], [r["idf"] for r in known])

    def weights(self, texts: DataFrame) -> DataFrame:
        """``id, n, term, w``: the weights of the model's terms in ``id, text``."""
        rows = self.sparse(texts).select("id", F.inline(F.arrays_zip(F.col("at").alias("n"), "w")))
        return rows.join(F.broadcast(self.terms.select("n", "term")), "n").select("id", "n", "term", "w")

    def encode(self, texts: DataFrame) -> DataFrame:
        """``id, embedding`` of length 1 for every id; a text without any of the model's terms has zeros."""
        known = self.terms.orderBy("n").select("components").collect()
        components = np.array([r["components"] for r in known], float) if known else np.zeros((0, 1))
        return V.embed(self.sparse(texts), components)


BACKENDS: dict[str, Callable[..., TermModel]] = {TermModel.name: TermModel.fit}


def fitted(chunks: DataFrame, folder: str, backend: str = TermModel.name, force_fallback: bool = False, **settings) -> TermModel:
    """A backend of that name fitted on ``id, text``; the fallback if it is forced, or no such backend is registered."""
    return BACKENDS[backend if backend in BACKENDS and not force_fallback else TermModel.name](chunks, folder, **settings)


def chunked(texts: DataFrame, text: Column, size: int = 800, overlap: int = 150) -> DataFrame:
    """The rows of ``texts`` for each chunk of ``size`` words of its text, with ``chunk`` (from 0) and ``chunk_text``; none for a text without words."""
    words = texts.withColumn("__w", F.filter(F.split(text, r"\s+"), lambda x: x != "")).withColumn("__n", F.size("__w")).filter("__n > 0")
    step = size - overlap
    places = F.sequence(F.lit(0), F.greatest(F.ceil((F.col("__n") - size) / step), F.lit(0)).cast("int"))
    pieces = F.transform(places, lambda k: F.struct(k.alias("chunk"), F.array_join(F.slice("__w", k * step + 1, F.lit(size)), " ").alias("chunk_text")))
    return words.select(*texts.columns, F.inline(pieces))  # the words themselves don't go along with each chunk
