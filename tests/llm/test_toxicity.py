import math
import random
from zlib import crc32

import numpy as np

from sparvane.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score string, toxic string"


def corpus(n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["an", "the", "ion", "re", "st", "ou", "er"], k=rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilgrub", "klumpf"]) + rng.choice(["", "en", "ou"])
        docs.append((i, " ".join(words), "en", "x", "y"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus()
    docs += [(None, None, None, None, None), (10_000, "", "", "", ""), (10_001, "vilgrub " * 20_000, "", "", ""), docs[6]]
    frame = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame, known).toPandas()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    held = got[got.held_out]
    assert set(held.doc_id.dropna().astype(int)) == {i for i, *_ in docs if i is not None and crc32(str(i).encode()) % 3 == 1}
    right = [truth[int(r.doc_id)] == r.predicted for r in held.itertuples() if r.doc_id in truth]
    assert np.mean(right) > 0.97
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert got[got.doc_id == 10_001].predicted.tolist() == [1]
    kept = toxicity.keep_ordinary(frame, known)
    assert kept.columns == frame.columns and kept.count() == (got.predicted == 0).sum()
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, q, 1 - t if crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = toxicity.score(frame, other).toPandas()
    assert sorted(again.score) == sorted(got.score)


def test_empty_tables(spark):
    docs, labels = corpus(12)
    frame, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.score(frame.limit(0), known).count() == 0
    assert {r.score for r in toxicity.score(frame, known.limit(0)).collect()} == {0.5}


def test_kneser_ney_sums_to_one_and_backs_off_alike():
    model = toxicity.KneserNey({"abcab": 3, "abd": 2}, {"bca": 5, "cab": 1})
    letters = ["a", "b", "c", "d", chr(toxicity._END)]
    # after a context that neither class has seen at its top orders both classes agree
    assert abs(model.ratios(["ddddd"])[0] - model.ratios(["dddddd"])[0]) < 1e-9
    grams, contexts, _ = model._inner(["ab" + x for x in letters[:4]] + ["ab"])
    last = [i for i in range(grams.shape[1]) if contexts[2][i] == contexts[2][2]]
    p = np.full(grams.shape[1], 1.0 / (model.letters + 1))
    for n, level in enumerate(model.shared):
        p = model._step(level, grams[n], contexts[n], p)
    assert 0 < sum({grams[3][i]: p[i] for i in last}.values()) <= 1 + 1e-9
    assert all(math.isfinite(x) for x in model.ratios(["", "a", "zzz", "ß" * 300]))


def slow_ratios(classes, words):
    """Log-likelihood ratios by dictionaries of letter tuples."""
    def grams(word, n):
        s = [toxicity._START] * (toxicity.ORDER + 1) + list(map(ord, word)) + [toxicity._END]
        return [tuple(s[i - n + 1 : i + 1]) for i in range(toxicity.ORDER + 1, len(s))]

    def level(counts):
        totals, kinds = {}, {}
        for g, c in counts.items():
            totals[g[:-1]] = totals.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        return counts, totals, kinds

    shared = []
    for n in range(1, toxicity.SHARED + 1):
        longer = {g for c in classes for w in c for g in grams(w, n + 1)}
        counts = {}
        for g in longer:
            counts[g[1:]] = counts.get(g[1:], 0) + 1
        shared.append(level(counts))
    tops = []
    for c in classes:
        own = []
        for n in range(toxicity.SHARED + 1, toxicity.ORDER + 1):
            counts = {}
            for w, k in c.items():
                for g in grams(w, n):
                    counts[g] = counts.get(g, 0) + k
            own.append(level(counts))
        tops.append(own)

    def chance(word, own):
        total = 0.0
        for i in range(len(word) + 1):
            p = 1 / (max(2, len(shared[0][0])) + 1)
            for n, (counts, totals, kinds) in enumerate([*shared, *own], 1):
                g = grams(word, n)[i]
                if g[:-1] in totals:
                    p = max(counts.get(g, 0) - toxicity.DISCOUNT, 0) / totals[g[:-1]] + toxicity.DISCOUNT * kinds[g[:-1]] / totals[g[:-1]] * p
            total += math.log(p)
        return total

    return [chance(w, tops[0]) - chance(w, tops[1]) for w in words]


def test_ratios_equal_brute_force_however_words_arrive():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 7)))
    toxic, ordinary = ({word(): rng.randint(1, 5) for _ in range(150)} for _ in range(2))
    asked = [word() for _ in range(200)] + ["", "zzz", *list(toxic)[:20]]
    wanted = slow_ratios((toxic, ordinary), asked)
    assert np.allclose(toxicity.KneserNey(toxic, ordinary).ratios(asked), wanted)
    model, both = toxicity.KneserNey(), sorted({*toxic, *ordinary})
    for w in both:  # one by one, documents of a word in two parts
        t, o = toxic.get(w, 0), ordinary.get(w, 0)
        model.add([w], [t // 2], [o // 2])
        if rng.random() < 0.1:
            model._count()
        model.add([w], [t - t // 2], [o - o // 2])
    model.finish()
    assert np.allclose(model.ratios(asked), wanted)
