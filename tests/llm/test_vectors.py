import math

import numpy as np
from pyspark.sql import functions as F

from sparvane.llm import annsearch, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def rows(n=60, dim=5, seed=1):
    rng = np.random.default_rng(seed)
    data = [(i, [float(x) for x in rng.normal(size=dim)], "s", None) for i in range(n)]
    data += [(100, [float("nan")] * dim, "", ""), (200, None, "", ""), (300, [None] * dim, "", ""), (400, [0.0] * dim, "", ""), (None, [1.0] * dim, "", "")]
    data += [(7, data[7][1], "", ""), (500, data[3][1], "", ""), (501, data[3][1], "", ""), (600, [1.0, 2.0], "", ""), (601, [2.0, 1.0], "", ""), (700, [math.inf] * dim, "", "")]
    return data


def brute(data, modulus, k, measure, skip_zero):
    good = [(i, v) for i, v, *_ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not skip_zero)]
    out, asked = [], set()
    for q, v in good:
        if q % modulus == 0 and q not in asked:
            asked.add(q)
            ranked = sorted(((-measure(v, w), i) for i, w in good if i != q and len(w) == len(v)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return sorted(out)


def test_exact_top_k(spark):
    data = rows()
    whole = lambda v: [math.floor(1024 * x) for x in v]
    wanted = brute(data, 10, 4, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b))), False)
    frame = spark.createDataFrame(data, SCHEMA)
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 10 == 0, k=4).collect())) == wanted
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_many_blocks_and_tiles_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 8)
    data = rows(n=300)
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 2 == 0, k=4).collect()))
        near = sorted(map(tuple, annsearch.nearest(frame, F.col("vec_id") % 2 == 0, k=4).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = lambda v: [math.floor(1024 * x) for x in v]
    assert got == brute(data, 2, 4, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b))), False)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    wanted = brute(data, 2, 4, cosine, True)
    assert np.allclose([x[3] for x in near], [x[3] for x in wanted])


def test_no_vector_is_shuffled_to_meet_a_query(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    plan = topk.top_k(frame, F.col("vec_id") % 10 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "embedding" not in plan.split("MapInArrow")[0]


def test_products_stay_exact_for_large_numbers():
    left, right = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**30, 3.0]])
    assert topk._products(left, right).tolist() == [[2**60 + 1, 2**63 - 1]]


def test_nearest_finds_all_on_a_small_table_and_most_on_a_larger_one(spark):
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    data = rows()
    frame = spark.createDataFrame(data, SCHEMA)
    got = sorted(map(tuple, annsearch.nearest(frame, F.col("vec_id") % 10 == 0, k=4).collect()))
    wanted = brute(data, 10, 4, cosine, True)
    assert [(q, r) for q, r, *_ in got] == [(q, r) for q, r, *_ in wanted]
    assert np.allclose([x[3] for x in got], [x[3] for x in wanted])
    assert annsearch.nearest(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    data = rows(n=3000, dim=32, seed=3)
    got = {(q, i) for q, _, i, _ in annsearch.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 100 == 0).collect()}
    wanted = {(q, i) for q, _, i, _ in brute(data, 100, 5, cosine, True)}
    assert len(got & wanted) >= 0.9 * len(wanted)


def test_beam_search_beats_greedy_codes():
    points = np.random.default_rng(0).normal(size=(400, 16)).astype(np.float32)
    books = annsearch.fit(points, annsearch.Settings(books=4, words=16))
    error = lambda beam: ((points - books.decode(books.encode(points, beam)[0])) ** 2).sum()
    assert error(8) < error(1)
