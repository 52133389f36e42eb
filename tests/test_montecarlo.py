"""Moments, clouds and their distances against numpy on the same numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvane.operators import moments as M
from sparvane.operators import montecarlo as Q
from sparvane.operators.stats import draws
from sparvane.plans import catalogue as C
from sparvane.plans import montecarlo as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def runs(spark):
    rows = C.run_vectors(spark, SF).collect()
    return {a: np.array([r["embedding"] for r in sorted((r for r in rows if r["agent"] == a), key=lambda r: r["run"])]) for a in {r["agent"] for r in rows}}


def boot(runs, a):
    b = np.arange(Q.DRAWS)
    return runs[a][Q.mixed(b, len(runs[a]), Q.SEED) % len(runs[a])].mean(axis=1)


def test_moments_and_axes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 100
    x[:, 4] = 7.0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").repartition(7)
    m = M.moments(rows, "v")
    assert m.n == 500 and np.allclose(m.covariance(), np.cov(x.T, ddof=0)) and np.allclose(m.covariance(1), np.cov(x.T))
    scaled = M.Axes.fit(m, 5, scaled=True)
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    assert np.allclose(scaled.shares, (np.linalg.svd(z)[1] ** 2 / (z**2).sum())[:5], atol=1e-12)
    got = np.array([r["coordinates"] for r in M.project(rows, "v", scaled).orderBy("i").collect()])
    assert np.allclose(got @ got.T, z @ z.T, atol=1e-8)
    assert M.moments(rows.limit(0), "v") is None and M.moments(rows.limit(1), "v").n == 1
    assert M.enough(np.array([0.6, 0.3, 0.06, 0.04])) == 3 and M.enough(np.array([0.5, 0.4]), 0.95, 2) == 2


def test_components_needed(spark):
    x = np.array([r["embedding"] for r in P.vectors(spark, SF).collect()], float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    shares = np.linalg.svd(z)[1] ** 2 / (z**2).sum()
    most = min(len(x) - 1, 64, 50)
    rows = P.components_needed(spark, SF).orderBy("component").collect()
    assert np.allclose([r["share"] for r in rows], shares[:most])
    assert sum(r["kept"] for r in rows) == min(most, int(np.searchsorted(np.cumsum(shares[:most]), 0.95)) + 1)


def test_numbers_equal_the_columns(spark):
    slots = spark.createDataFrame([(0, k, 5) for k in range(6)], "a long, k long, n long")
    rows = draws(50, slots).collect()
    wanted = Q.mixed(np.arange(50), 6, 42) % 5
    assert all(wanted[r["b"], r["k"]] == r["i"] for r in rows) and len(rows) == 300
    z = Q.normals(np.arange(300), 3)
    assert all(abs(z[r["b"], r["d"]] - r["z"]) < 1e-12 for r in Q.normal_numbers(spark, 300, 3).collect())
    many = Q.normals(np.arange(20_000), 4)
    assert np.abs(many.mean(axis=0)).max() < 0.03 and np.abs(np.cov(many.T) - np.eye(4)).max() < 0.04


@pytest.mark.parametrize("shape", [(8, 3), (8, 64), (1, 4), (4, 4)])
def test_satellites_have_the_covariance_of_their_model(spark, shape):
    runs = np.random.default_rng(1).normal(size=shape) * 3 + 5
    frame = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(runs)], "agent string, run int, v array<double>")
    points = np.array([r["point"] for r in Q.clouds(frame, "v", "gaussian").orderBy("b").collect()])
    mean, factor = Q.satellite_model(runs)
    assert points.shape == (Q.DRAWS, shape[1]) and np.allclose(points, mean + Q.normals(np.arange(Q.DRAWS), len(factor)) @ factor)
    wide = shape[1] >= shape[0]
    x = (runs - runs.mean(axis=0)) / np.where(runs.std(axis=0) == 0, 1, runs.std(axis=0)) if wide else runs
    wanted = (np.cov(x.T) if shape[0] > 1 else np.eye(shape[1]) * 1e-6) + Q.RIDGE * np.eye(shape[1])
    lost = 0.05 if wide else 0  # the components beyond 95 % of the variance
    assert abs(np.trace(np.cov(points.T)) / np.trace(wanted) - 1) < lost + 0.05 or shape[0] == 1
    assert np.abs(np.cov(points.T) - wanted).max() < (lost + 0.1) * max(np.trace(wanted), 1e-3)


def test_bootstrap_cloud_and_its_distances(spark, runs, monkeypatch):
    cloud = P.bootstrap_cloud(spark, SF)
    a = min(runs)
    got = np.array([r["point"] for r in cloud.filter(F.col("agent") == a).orderBy("b").collect()])
    assert np.allclose(got, boot(runs, a))
    centres = {a: r.mean(axis=0) for a, r in runs.items()}
    far = np.stack([np.linalg.norm(got - centres[k], axis=1) for k in sorted(centres) if k != a])
    own = np.linalg.norm(got - centres[a], axis=1)
    for tile in (Q.TILE, 3):  # centroids in one tile and in many
        monkeypatch.setattr(Q, "TILE", tile)
        near = Q.centroid_distances(cloud.filter(F.col("agent") == a), P.centroids(spark, SF))
        rows = near.orderBy("b").collect()
        assert np.allclose([r["own"] for r in rows], own) and np.allclose([r["other"] for r in rows], far.min(axis=0))
    row = Q.cloud_errors(near).first()
    assert row["nearest_centroid_overlap"] == pytest.approx((far.min(axis=0) < own).mean()) and row["n_satellites"] == Q.DRAWS


def test_one_producer_has_no_overlap(spark):
    runs = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(3)], "agent string, run int, v array<double>")
    near = Q.centroid_distances(Q.clouds(runs, "v", "bootstrap", 20), spark.createDataFrame([("a", [1.0, 1.0])], "agent string, centroid array<double>"))
    row = Q.cloud_errors(near).first()
    assert row["nearest_centroid_overlap"] is None and row["n_satellites"] == 20
    assert Q.clouds(runs.limit(0), "v", "gaussian", 20).count() == 0


def test_evenly_spaced_draws(spark):
    for total, most in ((10_000, 2000), (10_000, 1999), (100, 7), (50, 2), (30, 30), (5, 9)):
        got = [r["id"] for r in spark.range(total).filter(Q.evenly("id", total, most)).orderBy("id").collect()]
        assert got == sorted(set(np.linspace(0, total - 1, min(most, total), dtype=int).tolist()))


def test_views_and_first_component(spark, runs):
    picked = np.linspace(0, Q.DRAWS - 1, 2000, dtype=int)
    clouds = {a: boot(runs, a) for a in sorted(runs)}
    fit = np.vstack([*(runs[a] for a in sorted(runs)), *(c[picked] for c in clouds.values())])
    _, s, vt = np.linalg.svd(fit - fit.mean(axis=0), full_matrices=False)
    rows = P.satellite_views(spark, SF).collect()
    assert len(rows) == sum(map(len, runs.values())) + len(runs) * 2001
    for r in rows[:: max(1, len(rows) // 200)]:
        x = {"run": lambda: runs[r["agent"]][r["number"]] if len(runs[r["agent"]]) == 8 else None, "bootstrap": lambda: clouds[r["agent"]][r["number"]], "centroid": lambda: runs[r["agent"]].mean(axis=0)}[r["kind"]]()
        if x is not None:
            assert np.allclose(np.abs((x - fit.mean(axis=0)) @ vt[:3].T), np.abs([r["pc1"], r["pc2"], r["pc3"]]), atol=1e-4)
    every = np.vstack(list(clouds.values()))
    _, _, vt = np.linalg.svd(every - every.mean(axis=0), full_matrices=False)
    axis = vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
    for r in P.cloud_first_component(spark, SF).collect():
        x = (clouds[r["agent"]] - every.mean(axis=0)) @ axis
        assert np.allclose([r["centroid_pca1_mean"], r["centroid_pca1_sd"], r["centroid_pca1_ci95_lo"]], [x.mean(), x.std(), np.percentile(x, 2.5)], atol=1e-5)
