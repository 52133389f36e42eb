"""Chunk embeddings: a model of a whole corpus, kept and used again."""

import numpy as np

from sparvane.operators import embedding as E
from sparvane.operators import vectors as V

TEXTS = ["alpha beta beta gamma", "beta gamma delta", "alpha alpha delta", "gamma gamma beta alpha", "delta epsilon", "", None]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def dense(model, texts):
    """Weights by hand, and their product with the model's components."""
    terms = model.terms.orderBy("n").collect()
    at = {r["term"]: i for i, r in enumerate(terms)}
    x = np.zeros((len(texts), len(terms)))
    for i, t in enumerate(texts):
        words = [w for w in (t or "").lower().split() if len(w) > 1]
        found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        for term in set(found) & at.keys():
            x[i, at[term]] = (1 + np.log(found.count(term))) * terms[at[term]]["idf"]
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms), np.array([r["components"] for r in terms])


def test_fit_keep_and_reuse(spark, tmp_path):
    model = E.fitted(rows(spark, TEXTS), str(tmp_path / "m"), "a backend that isn't there", components=3)
    x, components = dense(model, TEXTS)
    df = (x > 0).sum(axis=0)
    idf = np.array([r["idf"] for r in model.terms.orderBy("n").collect()])
    assert np.allclose(idf, np.log((1 + len(TEXTS)) / (1 + df)) + 1)
    vt = np.linalg.svd(x)[2][:3]
    assert np.allclose(np.abs(np.sum(vt * components.T, axis=1)), 1, atol=1e-3)
    again = E.TermModel.load(spark, str(tmp_path / "m"))
    later = ["beta alpha unseen", "nothing known here", None, "delta"]
    for texts in (TEXTS, later):
        got = np.array([r["embedding"] for r in again.encode(rows(spark, texts)).orderBy("id").collect()])
        x, _ = dense(again, texts)
        wanted = x @ components
        size = np.linalg.norm(wanted, axis=1, keepdims=True)
        assert got.shape == (len(texts), 3) and np.allclose(got, wanted / np.where(size == 0, 1, size), atol=1e-5)


def test_registry_and_no_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(E.BACKENDS, "own", lambda chunks, folder: "mine")
    assert E.fitted(None, "", "own") == "mine"
    model = E.fitted(rows(spark, [None, ""]), str(tmp_path / "m"), "own", force_fallback=True)
    assert model.terms.count() == 0 and [r["embedding"] for r in model.encode(rows(spark, ["a word", None])).collect()] == [[0.0], [0.0]]


def test_chunks(spark):
    from pyspark.sql import functions as F

    frame = rows(spark, [" ".join(map(str, range(25))), "  ", None, "one two", " ".join(map(str, range(10)))])
    got = [(r["id"], r["chunk"], r["chunk_text"]) for r in E.chunked(frame, F.col("text"), 10, 3).orderBy("id", "chunk").collect()]
    words = list(map(str, range(25)))
    assert got == [*((0, k, " ".join(words[7 * k : 7 * k + 10])) for k in range(4)), (3, 0, "one two"), (4, 0, " ".join(words[:10]))]


def test_sparse_products_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(V, "ENTRIES", 3)
    rng = np.random.default_rng(1)
    x = rng.random((9, 7)) * (rng.random((9, 7)) < 0.6)
    sparse = spark.createDataFrame([(i, [int(j) for j in np.flatnonzero(v)], [float(w) for w in v[v > 0]]) for i, v in enumerate(x)], "id int, at array<int>, w array<double>")
    found = V.fit_components(sparse, 7, 2, rounds=40)
    assert np.allclose(np.abs(np.sum(np.linalg.svd(x)[2][:2] * found.T, axis=1)), 1, atol=1e-6)
    got = np.array([r["embedding"] for r in V.embed(sparse, found).orderBy("id").collect()])
    wanted = x @ found
    assert np.allclose(got, wanted / np.where((n := np.linalg.norm(wanted, axis=1, keepdims=True)) == 0, 1, n), atol=1e-5)
