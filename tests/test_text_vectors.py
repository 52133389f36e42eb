import math

import numpy as np
from pyspark.sql import functions as F

from sparvane.operators import vectors

TEXTS = ["The cat sat on the mat", "the dog sat", "Cats and dogs and mats", "", None, "été à la mer, été", "a b c", "dog dog dog cat"]


def dense(texts):
    """TF-IDF by dictionaries."""
    import re
    from collections import Counter

    counts = []
    for t in texts:
        words = re.findall(r"\b\w\w+\b", (t or "").lower())
        counts.append(Counter(words + [" ".join(p) for p in zip(words, words[1:])]))
    names = sorted({w for c in counts for w in c})
    out = np.zeros((len(texts), len(names)))
    for i, c in enumerate(counts):
        for w, n in c.items():
            df = sum(w in d for d in counts)
            out[i, names.index(w)] = (1 + math.log(n)) * (1 + math.log((1 + len(texts)) / (1 + df)))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size == 0, 1, size), names


def test_tfidf_and_components_equal_dense_ones(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    wanted, names = dense(TEXTS)
    weights = vectors.tfidf(frame)
    got = {(r.id, r.term): r.w for r in weights.collect()}
    assert len(got) == (wanted > 0).sum()
    assert all(abs(got[i, names[j]] - wanted[i, j]) < 1e-12 for i, j in zip(*np.nonzero(wanted)))
    rows, found = vectors.sparse_rows(weights)
    assert found == names
    basis = vectors.fit_components(rows, len(names), components=3, rounds=30)
    exact = np.linalg.svd(wanted)[2][:3].T
    assert np.allclose(basis @ basis.T, exact @ exact.T, atol=1e-6)
    unit = {r.id: np.array(r.embedding) for r in vectors.embed(rows, basis).collect()}
    for i, v in unit.items():
        p = wanted[i] @ exact
        assert abs(np.linalg.norm(v) - 1) < 1e-5 and abs(abs(v @ v) - 1) < 1e-5 and np.allclose(np.abs(v @ v), 1, atol=1e-5)
        for j, w in unit.items():
            q = wanted[j] @ exact
            assert abs(v @ w - p @ q / np.linalg.norm(p) / np.linalg.norm(q)) < 1e-4
    assert vectors.tfidf(frame, most=2).select("term").distinct().count() == 2
    assert vectors.tfidf(frame.limit(0)).count() == 0


def test_principal_components_keep_distances_and_shares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 5)) * [5, 3, 1, 1, 0]
    coordinates, shares = vectors.principal(x, 5, scaled=False)
    between = lambda m: ((m[:, None] - m[None]) ** 2).sum(2)
    assert np.allclose(between(coordinates), between(x)) and abs(shares.sum() - 1) < 1e-12 and (np.diff(shares) <= 1e-12).all()
    assert np.allclose(np.cov(coordinates.T) - np.diag(np.diag(np.cov(coordinates.T))), 0, atol=1e-9)
    assert vectors.enough(np.array([0.6, 0.3, 0.06, 0.04])) == 3 and vectors.enough(np.array([1.0])) == 1
    runs = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)], "agent string, run int, v array<double>")
    got = vectors.run_components(runs, "v", 3).toPandas()
    assert len(got) == 60 and got[got.pc == 1].explained.iloc[0] >= got[got.pc == 2].explained.iloc[0]


def test_partial_least_squares_fits_least_squares_with_all_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    y = x @ [1.0, 2.0, 0.0, -1.0] + rng.normal(scale=0.1, size=30)
    model = vectors.partial_least_squares(x, y, 4)
    exact = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    assert np.allclose(model["coefficients"], exact, atol=1e-8)
    vip = vectors.importance(vectors.partial_least_squares(x, y, 2))
    assert abs((vip**2).sum() - 4) < 1e-9 and vip[1] == vip.max()
    cells = [(f"f{j}", f"s{i}", "case" if i % 2 else "control", float(v + (3 if i % 2 and j == 0 else 0))) for i, r in enumerate(x[:12]) for j, v in enumerate(r)]
    got = vectors.discriminate(spark.createDataFrame(cells, "feature string, sample string, grp string, v double")).toPandas()
    assert got.sort_values("vip").feature.iloc[-1] == "f0" and 0 < got.q2.iloc[0] < got.r2.iloc[0] <= 1


def test_pooling_is_unweighted_at_each_level(spark):
    rows = spark.createDataFrame([("a", 1, 1, [0.0]), ("a", 1, 1, [0.0]), ("a", 1, 1, [0.0]), ("a", 1, 2, [6.0]), ("a", 2, 3, [9.0])], "agent string, run int, file int, embedding array<double>")
    assert vectors.pooled(rows, [["agent", "run", "file"], ["agent", "run"], ["agent"]]).first().embedding == [6.0]
    assert rows.select(F.size(vectors.terms(F.lit("one two three")))).first()[0] == 5
