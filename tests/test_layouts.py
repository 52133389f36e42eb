"""Layouts against small dense versions on the same start, with several strips."""

import numpy as np
import pytest

from sparvane.operators import layouts as L


@pytest.fixture
def items(spark, monkeypatch):
    monkeypatch.setattr(L, "STRIP", 9)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(10, 6)) * 0.3 + 4 * c for c in range(3)])
    x = np.c_[x, np.full(30, 2.0)]
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    frame = spark.createDataFrame([(i // 10, i % 10, v.tolist()) for i, v in enumerate(x)], "agent int, run int, v array<double>").repartition(5)
    return frame, np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))


def test_distances(items):
    frame, wanted = items
    far, keys = L.distances(frame, ["agent", "run"], "v")
    assert np.allclose(far.gather(lambda _, x: x, 30), wanted) and keys == [(i // 10, i % 10) for i in range(30)]
    assert far.rows.count() == 4


def test_majorisation_equals_the_dense_one(items):
    frame, far = items
    strips, _ = L.distances(frame, ["agent", "run"], "v")
    at, stress = L.majorise(strips, rounds=40)
    x, dense = L.start_positions(30, 1.0, 42), []
    for _ in range(len(stress)):
        now = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        dense.append(((now - far) ** 2).sum() / 2)
        b = -np.divide(far, now, out=np.zeros_like(far), where=now > 0)
        np.fill_diagonal(b, -b.sum(axis=1))
        last, x = x, b @ x / 30
    assert np.allclose(stress, dense) and all(a >= b for a, b in zip(stress, stress[1:]))
    assert np.allclose(at, last if len(stress) < 40 else x)


def test_neighbours_have_the_perplexity(items):
    _, far = items
    p = L.neighbours(0, far.copy(), 5.0)
    assert np.allclose(np.exp(-(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)), 5.0, rtol=1e-5)
    assert (np.diag(p) == 0).all() and np.allclose(p.sum(axis=1), 1)


def test_stochastic_neighbours_equal_the_dense_ones(items):
    frame, far = items
    strips, _ = L.distances(frame, ["agent", "run"], "v")
    p = L.neighbours(0, far.copy(), 5.0)
    p = (p + p.T) / 60
    assert np.allclose(L.affinities(strips, 5.0).gather(lambda _, x: x, 30), p)
    at, divergence = L.stochastic_neighbours(strips, rounds=80, early=25)
    x, speed, gains, dense = L.start_positions(30, 1e-4, 42), np.zeros((30, 2)), np.ones((30, 2)), []
    for number in range(30):
        away = x[:, None] - x[None]
        q = 1 / (1 + (away**2).sum(axis=2))
        np.fill_diagonal(q, 0)
        ratio = np.where(p > 0, p / np.where(q > 0, q / q.sum(), 1), 1)
        dense.append((p * np.log(ratio)).sum())
        gradient = 4 * ((((12 if number < 25 else 1) * p - q / q.sum()) * q)[:, :, None] * away).sum(axis=1)
        gains = np.maximum(np.where(speed * gradient < 0, gains + 0.2, gains * 0.8), 0.01)
        speed = (0.5 if number < 25 else 0.8) * speed - 50 * gains * gradient
        x = x + speed
    assert np.allclose(divergence[:25], dense[:25], rtol=1e-4) and divergence[-1] < divergence[0] and at.shape == (30, 2)


def test_neighbour_graph_equals_brute_force(items):
    frame, far = items
    strips, _ = L.distances(frame, ["agent", "run"], "v")
    one = np.zeros((30, 30))
    for i in range(30):
        order = [j for j in np.argsort(far[i], kind="stable") if j != i][:4]
        d = far[i, order]
        beyond, low, high = d - d.min(), 0.0, 1e6
        for _ in range(200):
            low, high = (low, (low + high) / 2) if np.exp(-beyond / ((low + high) / 2)).sum() > np.log2(5) else ((low + high) / 2, high)
        one[i, order] = np.exp(-beyond / high)
    wanted = one + one.T - one * one.T
    got = np.zeros((30, 30))
    for r in L.neighbour_graph(strips).collect():
        got[r["i"], r["to"]] = r["w"]
    assert np.allclose(got, wanted, atol=1e-7)


def test_graph_layout_is_the_same_over_any_partitions_and_keeps_groups(spark, items):
    strips, _ = L.distances(items[0], ["agent", "run"], "v")
    edges = spark.createDataFrame(L.neighbour_graph(strips).toPandas())
    one, two = (L.graph_layout(edges.repartition(p), 30, rounds=8) for p in (1, 4))
    assert np.allclose(one, two, atol=1e-9)
    one = L.graph_layout(edges, 30, rounds=60)
    near = np.argsort(((one[:, None] - one[None]) ** 2).sum(axis=2) + np.eye(30) * 1e9, axis=1)[:, 0]
    assert (near // 10 == np.arange(30) // 10).mean() > 0.8


def test_few_items(spark):
    rows = lambda n: spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(n)], "agent int, run int, v array<double>")
    for n in (0, 1, 3):
        far, keys = L.distances(rows(n), ["agent", "run"], "v")
        assert len(keys) == n and L.majorise(far)[0].shape == (n, 2) and L.stochastic_neighbours(far) is None
        assert L.graph_layout(L.neighbour_graph(far), n, 2).shape == (n, 2)


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST", 2)
    with pytest.raises(ValueError, match="2 at most"):
        L.distances(spark.createDataFrame([(i, [1.0 * i]) for i in range(3)], "agent int, v array<double>"), ["agent"], "v")
