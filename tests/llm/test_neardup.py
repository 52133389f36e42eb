import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvane.llm import common, neardup

SCHEMA = "doc_id long, text string, class string, key string, band string"


def brute_force(texts):
    """Class (smallest index) of each text: equal texts, and chains of pairs at 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        counts = {}
        for i in range(max(1, len(w) - 4)) if w else ():
            s = tuple(w[i : i + 5])
            counts[s] = counts.get(s, 0) + 1
        sets.append(counts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (texts[i] or "") == (texts[j] or "")
            if not same and a and b:
                common = sum(min(n, b.get(s, 0)) for s, n in a.items())
                same = common >= 0.8 * (sum(a.values()) + sum(b.values()) - common) - 1e-9
            if same:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=6))
    texts = [None, "", "  ", "\t", "one two", "one  TWO", "a b c d e", "a b c d e f", "x " * 5000, "x " * 4999]
    for size, copies in ((150, 60), (40, 10), (400, 8)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            new = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                new[rng.randrange(size)] = word()
            texts.append(" ".join(new))
    texts += [" ".join(word() for _ in range(30)) for _ in range(40)]
    texts += texts[10:40:3] + ["z" * 100_000 + " end"]
    return texts


def test_classes_equal_brute_force(spark):
    texts = corpus()
    frame = spark.createDataFrame([(i, t, "c", None, "b") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts)
    kept = neardup.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_a_large_group_of_near_copies_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=6))
    base, texts = [word() for _ in range(120)], []
    for _ in range(1200):  # copies near the limit: a chain holds together what no one member is close to
        new = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            new[rng.randrange(120)] = word()
        texts.append(" ".join(new))
    template = base[:60]
    texts += [" ".join(template + [word() for _ in range(60)]) for _ in range(150)]
    frame = spark.createDataFrame([(i, t, "c", None, "b") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    assert [got[i] for i in range(len(texts))] == fast_classes(texts)


def fast_classes(texts):
    """:func:`brute_force` for texts without repeated shingles, in one matrix product."""
    codes, rows = {}, []
    for t in texts:
        w = t.split()
        rows.append([codes.setdefault(tuple(w[i : i + 5]), len(codes)) for i in range(len(w) - 4)])
    have = np.zeros((len(texts), len(codes)), np.float32)
    for i, r in enumerate(rows):
        have[i, r] = 1
    common = have @ have.T
    size = have.sum(1)
    near = common >= 0.8 * (size[:, None] + size[None] - common) - 1e-4
    label = np.arange(len(texts))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(texts))])
        if (new == label).all():
            return label.tolist()
        label = new


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "same text here again and again", "", "", ""), (4, "same text here again and again", "", "", ""), (4, "same text here again and again", "", "", ""), (4, "another", "", "", ""), (None, "alone", "", "", ""), (None, None, "", "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_docs) for r in neardup.classes(frame).collect())
    assert got == [("4", "4", 1), ("4", "4", 3), ("4", "4", 3), ("None", "4", 3), ("None", "None", 1), ("None", "None", 1)]
    assert sorted(str(r.doc_id) for r in neardup.keep_one(frame).collect()) == ["4", "4", "None", "None"]
    assert neardup.classes(frame.limit(0)).count() == 0
    assert neardup.keep_one(frame.limit(0)).count() == 0


def test_agreement_of_signatures_estimates_weighted_similarity():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(2000)]
    gaps = []
    for size in (8, 60, 300, 3000):
        for _ in range(12):
            a = [rng.choice(words) for _ in range(size)]
            b = list(a)
            for _ in range(max(1, size // 25)):
                b[rng.randrange(size)] = rng.choice(words)
            x, y = neardup.units(" ".join(a)), neardup.units(" ".join(b))
            common = len(np.intersect1d(x, y))
            s = neardup.signatures([x, y])
            assert not (s == neardup._EMPTY).any()
            gaps.append((s[0] == s[1]).mean() - common / (len(x) + len(y) - common))
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.1


def test_picking_fails_if_rows_are_numbered_differently(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    folder, n = common.write_row_sets(neardup._rows(rows).filter("doc_id % 5 = 1"))
    assert n == 10
    picked = common.all_there(common.pick_rows(neardup._rows(rows), folder), n)
    assert sorted(r.doc_id for r in picked.collect()) == list(range(1, 50, 5))
    with pytest.raises(Exception, match="number the rows differently"):
        common.pick_rows(neardup._rows(rows.orderBy(F.desc("doc_id")).coalesce(1)), folder).collect()


def test_missing_rows_fail(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").repartition(3, "doc_id")
    folder, n = common.write_row_sets(neardup._rows(rows))
    with pytest.raises(RuntimeError, match="of 50 chosen rows"):
        common.all_there(common.pick_rows(neardup._rows(rows.limit(0)), folder), n)
