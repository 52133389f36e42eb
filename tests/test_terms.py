"""Frequent terms in two passes, and weights where the texts lie."""

import math
import random
import re
from collections import Counter

import pytest

from sparvane.operators import terms as W
from sparvane.plans import embeddings

SF = "/root/testdata/sf0.001"


def counts(text):
    words = re.findall(r"\w\w+", (text or "").lower())
    return Counter(words + [" ".join(p) for p in zip(words, words[1:])])


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_frequent_terms_and_weights_equal_plain_counts(spark, bits):
    rng = random.Random(bits)
    names = [f"w{i}" for i in range(60)] + ["é", "été", "ÉTÉ", "x", "_y"]
    texts = [" ".join(rng.choices(names, [1 / (i + 1) for i in range(len(names))], k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "x . x"]
    ids = [*range(40), 3, 3, None]  # an id of three texts: no pair runs from one into the next
    merged = {}
    for i, t in zip(ids, texts):
        merged.setdefault(i, Counter()).update(counts(t))
    total, df = sum(merged.values(), Counter()), Counter(t for c in merged.values() for t in c)
    worded = W.worded(spark.createDataFrame(list(zip(ids, texts)), "id int, text string"))
    for most in (1, 25, 10_000):
        top = sorted(total, key=lambda t: (-total[t], t))[:most]
        found = W.frequent(worded, most, bits)
        assert found == sorted((t, df[t]) for t in top)
        terms = [t for t, _ in found]
        rows = W.weighed(worded, terms, [1.0 + n for n in range(len(terms))]).collect()
        assert len(rows) == len(merged)
        for r in rows:
            w = {n: (1 + math.log(merged[r.id][t])) * (1 + n) for n, t in enumerate(terms) if t in merged[r.id]}
            size = math.sqrt(sum(x * x for x in w.values()))
            assert r["at"] == sorted(w) and all(abs(x - w[n] / size) < 1e-12 for n, x in zip(r["at"], r["w"]))


@pytest.mark.parametrize("name", ["tfidf_weights", "chunk_weights", "reused_weights"])
def test_texts_terms_are_not_shuffled(spark, name):
    plan = getattr(embeddings, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # before: by (id, term), by term and by id


def test_a_fit_reads_texts_before_its_rounds_only(spark, monkeypatch):
    from sparvane.operators import vectors as V

    seen = []
    fit = V.fit_components
    monkeypatch.setattr(V, "fit_components", lambda rows, *a, **k: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or fit(rows, *a, **{**k, "rounds": 1}))
    embeddings.embedded_runs(spark, SF, 2)
    assert len(seen) == 1 and "parquet" not in seen[0] and "regexp" not in seen[0]  # before: terms were found anew in every round


def test_means_of_few_vectors(spark):
    from sparvane.operators import vectors as V

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 7.0])], "k int, embedding array<float>")
    assert sorted(map(tuple, V.mean_of_few(rows, ["k"]).collect())) == sorted(map(tuple, V.pooled(rows, [["k"]]).collect()))
