"""Toxicity by class-conditional Kneser-Ney models.

A word is the string of its letters, so rare inflections and compounds share what their
letters share.  For each class (toxic, ordinary) a Kneser-Ney model predicts a word letter
by letter from up to ORDER - 1 letters before.  Its highest order counts the class's own
words; the lower ones are continuation counts over both classes, so an expression that
either class has seen too rarely falls back to the same shared estimate in both and speaks
for neither.  A window of WINDOW words compares the two length-normalised log-likelihoods;
a document's features are its most toxic window, the mean of its most toxic three, and the
whole text.  A logistic regression turns them into a score; it is fitted on documents that
the models it uses have not seen (two folds).

Labelled rows are learned from as a bounded sample: at most ``sample`` documents of each
class in expectation, chosen by a hash.  Everything else runs over all documents.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparvane.llm.common import cut_lineage, forget, fresh_folder, map_batches

ORDER, SHARED, DISCOUNT, WINDOW, SAMPLE = 6, 4, 0.75, 4, 1500
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = 1, 2


@dataclass
class _Level:
    """N-grams of one order: sorted codes, counts, and for each context its total and number of successors."""

    codes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray


def _level(codes: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> _Level:
    order = np.argsort(codes, kind="stable")
    context, inverse = np.unique(contexts, return_inverse=True)
    return _Level(codes[order], counts[order].astype(np.float64), context, np.bincount(inverse, counts, len(context)), np.bincount(inverse, minlength=len(context)).astype(np.float64))


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, 0 where there are none."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every letter of every word (and its end): hashes of the 1..ORDER letters up to it, and the word's number.

    Row n - 1 has the n-grams, row n - 1 of the contexts is row n - 2 one letter earlier.
    """
    text = "".join(chr(_START) + w + chr(_END) for w in words)
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(letters == _START)
    owner = np.cumsum(letters == _START) - 1
    depth = np.arange(len(letters)) - starts[owner] if len(letters) else np.zeros(0, np.int64)
    grams = np.zeros((ORDER, len(letters)), np.uint64)
    code = np.zeros(len(letters), np.uint64)
    for n in range(ORDER):
        back = np.zeros(len(letters), np.uint64)
        back[n:] = letters[: len(letters) - n]
        back[depth < n] = _START  # before its start a word is padded
        code = (code + back + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        grams[n] = code
    return grams, owner


class KneserNey:
    """The two class models over distinct words with their document counts, built chunk by chunk."""

    def __init__(self, toxic: dict[str, int] | None = None, ordinary: dict[str, int] | None = None) -> None:
        none = np.zeros(0, np.uint64)
        self._tops = [[(none, none, np.zeros(0)) for _ in range(SHARED, ORDER)] for _ in range(2)]
        self._longer = [(none, none, none) for _ in range(SHARED)]
        self._waiting: tuple[list, list, list] = ([], [], [])
        for words, of in ((toxic or {}, 0), (ordinary or {}, 1)):
            self.add(list(words), *([*words.values()] if of == c else [0] * len(words) for c in (0, 1)))
        self.finish()

    def add(self, words: list[str], toxic: list[int], ordinary: list[int]) -> None:
        """Counts words; one may come again, with further documents."""
        for held, new in zip(self._waiting, (words, toxic, ordinary)):
            held += new
        if len(self._waiting[0]) >= 50_000:
            self._count()

    def _count(self) -> None:
        words, *numbers = self._waiting
        grams, contexts, owner = self._inner(words)
        self._waiting = ([], [], [])
        for tops, n in zip(self._tops, numbers):
            weight = np.array(n, np.float64)[owner] if words else np.zeros(0)
            own = weight > 0
            for k, (codes, of, counts) in enumerate(tops):
                every, first, inverse = np.unique(np.r_[codes, grams[SHARED + k][own]], return_index=True, return_inverse=True)
                tops[k] = every, np.r_[of, contexts[SHARED + k][own]][first], np.bincount(inverse, np.r_[counts, weight[own]], len(every))
        for k, (longer, codes, of) in enumerate(self._longer):
            every, first = np.unique(np.r_[longer, grams[k + 1]], return_index=True)
            self._longer[k] = every, np.r_[codes, grams[k]][first], np.r_[of, contexts[k]][first]

    def finish(self) -> None:
        """Makes the models of all that was added."""
        self._count()
        self.classes = [[_level(*top) for top in tops] for tops in self._tops]
        self.shared = []
        for _, grams, contexts in self._longer:  # continuation counts: how many different letters precede the n-gram
            codes, first, counts = np.unique(grams, return_index=True, return_counts=True)
            self.shared.append(_level(codes, contexts[first], counts))
        self.letters = max(2, len(self.shared[0].codes))

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("classes", "shared", "letters")}

    @staticmethod
    def _inner(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """N-grams that end in a letter or a word's end, and their contexts."""
        grams, owner = _grams(words)
        contexts = np.zeros_like(grams)
        contexts[1:, 1:] = _context(grams)
        inside = np.r_[False, owner[1:] == owner[:-1]] if len(owner) else np.zeros(0, bool)
        return grams[:, inside], contexts[:, inside], owner[inside]

    def ratios(self, words: list[str]) -> np.ndarray:
        """For each word: log-likelihood as toxic less that as ordinary."""
        grams, contexts, owner = self._inner(words)
        p = np.full(grams.shape[1], 1.0 / (self.letters + 1))
        for n, level in enumerate(self.shared):
            p = self._step(level, grams[n], contexts[n], p)
        toxic = ordinary = p
        for n, (t, o) in enumerate(zip(*self.classes), SHARED):
            toxic, ordinary = self._step(t, grams[n], contexts[n], toxic), self._step(o, grams[n], contexts[n], ordinary)
        return np.bincount(owner, np.log(toxic) - np.log(ordinary), len(words))

    @staticmethod
    def _step(level: _Level, grams: np.ndarray, contexts: np.ndarray, p: np.ndarray) -> np.ndarray:
        total, kinds = _find(level.contexts, level.totals, contexts), _find(level.contexts, level.kinds, contexts)
        count, safe = _find(level.codes, level.counts, grams), np.maximum(total, 1.0)
        return np.where(total > 0, np.maximum(count - DISCOUNT, 0) / safe + DISCOUNT * kinds / safe * p, p)


def _context(grams: np.ndarray) -> np.ndarray:
    """Contexts of orders 2..ORDER at positions 1..: the shorter n-gram one position earlier."""
    return grams[:-1, :-1]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Ratios(dict):
    """Remembers words' log-likelihood ratios; a full table starts again."""

    def __init__(self, model: KneserNey, most: int = 400_000) -> None:
        super().__init__()
        self.model, self.most = model, most

    def learn(self, texts: list[list[str]]) -> None:
        if len(self) > self.most:
            self.clear()
        new = list({w for words in texts for w in words}.difference(self))
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            self.update(zip(part, self.model.ratios(part).tolist()))


def features(words: list[str], ratios: Ratios) -> tuple[float, float, float]:
    """Most toxic window, mean of the most toxic three, whole text: ratios per word; zeros without words."""
    if not words:
        return 0.0, 0.0, 0.0
    r = np.fromiter(map(ratios.__getitem__, words), np.float64, len(words))
    total = np.r_[0.0, np.cumsum(r)]
    width = min(WINDOW, len(r))
    windows = (total[width:] - total[:-width]) / WINDOW
    apart = np.maximum.reduceat(windows, np.arange(0, len(windows), WINDOW))
    best = np.sort(apart)[-3:]
    return float(windows.max()), float(np.r_[best, np.zeros(3 - len(best))].mean()), float(total[-1] / max(len(r), 20))


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``toxic, fold, text`` of the sample; rows whose crc32(doc_id as text) mod 3 is 1 never enter."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    sizes = dict(known.groupBy("toxic").count().collect())
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.filter(F.coalesce(*(F.when(F.col("toxic") == t, draw < min(1.0, sample / n)) for t, n in sizes.items()), F.lit(False))) if sizes else known
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = F.broadcast(chosen)  # ids alone, about twice ``sample`` at most
    return texts.join(chosen, "doc_id").select("toxic", (F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % 2).cast("int").alias("fold"), "text")


def _models(rows: DataFrame) -> str | None:
    """Builds three models of the sampled ``toxic, fold, text``: without fold 0, without fold 1, of all; None if a class is missing.

    Words with the numbers of documents that have them go to one task a model, which writes
    it to a file of the folder returned; the driver holds none.  Their size follows the
    different words of the sample.
    """
    folder = fresh_folder(rows.sparkSession, "toxicity")

    def work():
        def step(batch: dict) -> dict:
            out = {"toxic": [], "fold": [], "word": []}
            for toxic, fold, text in zip(*(batch[c].to_pylist() for c in ("toxic", "fold", "text"))):
                for word in set(words_of(text)):
                    for name, value in zip(out, (toxic, fold, word)):
                        out[name].append(value)
            return out

        return step

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        model, number, seen = KneserNey(), None, np.zeros(2)
        for batch in batches:
            number = batch.column("model")[0].as_py() if batch.num_rows else number
            counts = [batch.column(c).to_pylist() for c in ("t", "o")]
            model.add(batch.column("word").to_pylist(), *counts)
            seen += [sum(c) for c in counts]
        if number is None:
            return
        model.finish()
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{number}.{TaskContext.get().taskAttemptId()}", compression=None) as out:
            pickle.dump(model, out, protocol=5)
        system.move(f"{path}/{number}.{TaskContext.get().taskAttemptId()}", f"{path}/{number}")
        yield pa.RecordBatch.from_arrays([pa.array([int(seen.min() > 0)], pa.int32())], names=["both"])

    words = map_batches(rows, work, "toxic int, fold int, word string").groupBy("fold", "word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("o"))
    sent = words.select(F.explode(F.array(1 - F.col("fold"), F.lit(2))).alias("model"), "word", "t", "o").repartitionById(3, F.col("model")).sortWithinPartitions("model", "word")
    return folder if sent.mapInArrow(build, "both int").agg(F.coalesce(F.sum("both"), F.lit(0))).first()[0] == 3 else None


def _load(folder: str, number: int) -> KneserNey:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{number}", compression=None) as file:
        return pickle.load(file)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias, classes weighing alike, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge * w
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


@dataclass
class Scorer:
    """Where the model's file is (None: every score is 0.5), and the weights of its features."""

    folder: str | None
    weights: np.ndarray

    def ratios(self) -> Ratios:
        return Ratios(_load(self.folder, 2) if self.folder else KneserNey())

    def scores(self, texts: list[str | None], ratios: Ratios) -> list[float]:
        words = [words_of(t) for t in texts]
        ratios.learn(words)
        rows = np.array([(*features(w, ratios), 1.0) for w in words]).reshape(-1, 4)
        return (1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learns from ``labels`` (``doc_id, toxic``); without both classes in both folds every score is 0.5."""
    rows = cut_lineage(_training(docs, labels, sample))
    folder = _models(rows)
    if folder is None:
        return Scorer(None, np.zeros(4))

    def work():
        forget()
        ratios = [Ratios(_load(folder, f)) for f in (0, 1)]

        def step(batch: dict) -> dict:
            words, folds = [words_of(t) for t in batch["text"].to_pylist()], batch["fold"].to_pylist()
            for f in (0, 1):
                ratios[f].learn([w for w, g in zip(words, folds) if g == f])
            found = [features(w, ratios[f]) for w, f in zip(words, folds)]
            return {"toxic": batch["toxic"], **{c: [x[i] for x in found] for i, c in enumerate("abc")}}

        return step

    seen = map_batches(rows, work, "toxic int, a double, b double, c double").toArrow().to_pandas().sort_values(["toxic", "a", "b", "c"])
    return Scorer(folder, _logistic(seen[["a", "b", "c"]].to_numpy(), (seen["toxic"] == 1).to_numpy().astype(float)))


def _scored(docs: DataFrame, scorer: Scorer, columns: list[Column]) -> DataFrame:
    """Adds ``score`` (of column ``text``) to the chosen columns."""

    def work():
        forget()
        ratios = scorer.ratios()

        def step(batch: dict) -> dict:
            out, texts = [], batch["text"]
            for start in range(0, len(texts), 200):
                out += scorer.scores(texts[start : start + 200].to_pylist(), ratios)
            return batch | {"score": out}

        return step

    chosen = docs.select(*columns)
    return map_batches(chosen, work, StructType([*chosen.schema, StructField("score", DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id, text``).

    ``held_out``: crc32(doc_id as text) mod 3 is 1 (false for a null id); such rows are
    never learned from.  Very long texts are scored whole.  Null and empty texts score as texts without any window.  A label
    that stands twice counts as toxic if one says so; null labels are ignored.  Repeated
    rows keep a row each; other columns are ignored; an empty table gives no rows.
    """
    scorer = fit(docs, labels, sample)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    out = _scored(docs, scorer, columns)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    scorer = fit(docs, labels, sample)
    # The other columns travel beside the text, so no join is needed.
    out = _scored(docs, scorer, [F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text")])
    return out.filter(F.col("score") < threshold).select("row.*")
