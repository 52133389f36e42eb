import math

import numpy as np
import pytest

from sparvane.llm import queries
from sparvane.llm.whitening import Moments, symmetric_qr, whiten

SF = "/root/testdata/sf0.001"

SCHEMA = "vec_id long, embedding array<float>, n long, x string, component string"


def brute_force(vectors):
    """Exact sums, float covariance of the centred distinct vectors, and numpy's own eigenvectors."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums).astype(float) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    return n, deviation, ((n * x - sums).astype(float) / n) @ turn / np.sqrt(values), values / values.sum()


def test_eigenvectors_of_symmetric_matrices():
    rng = np.random.default_rng(5)
    for a in (rng.normal(size=(1, 1)), np.eye(7), np.zeros((4, 4)), np.ones((5, 5)), np.diag([3.0, 1, 2]), rng.normal(size=(30, 30)), np.diag(10.0 ** np.arange(-8, 8))):
        a = a + a.T
        values, vectors = symmetric_qr(a)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], rtol=1e-12, atol=1e-12 * np.abs(a).max())
        assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-13)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * max(1, np.abs(a).max()))


def test_streamed_and_merged_moments_equal_two_passes():
    rng = np.random.default_rng(6)
    x = rng.integers(10**6 - 50, 10**6 + 50, (5000, 6))
    parts = np.split(x, [0, 1, 3, 2500, 2500])
    total = Moments(6)
    for part in parts:
        one = Moments(6)
        for piece in np.array_split(part, 3):
            one.add(piece)
        total.merge(one)
    centred = x - x.mean(axis=0)
    assert total.n == 5000 and (total.sums == x.sum(axis=0)).all()
    assert np.allclose(total.covariance(), centred.T @ centred / 5000, rtol=1e-12, atol=1e-9)


def test_whole_table_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, wanted, shares = brute_force(table.embedding)
    got = queries.QUERIES["op13_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(table) and got.n.eq(n).all() and got.deviation.tolist() == np.repeat(deviation, 16).tolist()
    found = got.whitened.to_numpy().reshape(-1, 16)
    signs = np.sign((found * wanted[:, :16]).sum(axis=0))
    assert np.allclose(found * signs, wanted[:, :16], atol=1e-7)
    assert np.allclose(got.explained.to_numpy().reshape(-1, 16), shares[:16], rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [rng.normal(size=3).tolist() for _ in range(40)]
    rows = [(i, v, None, "x", "c") for i, v in enumerate(good)] + [(1, good[1], 5, None, None)] * 30
    rows += [(100, None, 1, "", ""), (101, [1.0, None, 2.0], 1, "", ""), (102, [float("nan"), 1.0, 2.0], 1, "", ""), (103, [float("-inf"), 1.0, 2.0], 1, "", ""), (104, [], 1, "", ""), (None, good[2], 1, "", "")]
    rows += [(200, [1.0, 2.0, 3.0, 4.0], 1, "", "")]  # of its own length, without any variance
    got = whiten(spark.createDataFrame(rows, SCHEMA), 2).toPandas()
    three, four = got[got.n == 40], got[got.n == 1]
    assert len(three) == 2 * 71 and three.vec_id.isna().sum() == 2 and (three.vec_id == 1).sum() == 62
    assert three.identity_error.max() < 1e-9 and three.whitened.notna().all()
    assert len(four) == 2 and four.whitened.isna().all() and four.explained.isna().all() and four.identity_error.isna().all() and (four.deviation == 0).all()
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_flat_components_are_null(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], None, None, None) for i in range(10)]
    got = whiten(spark.createDataFrame(rows, SCHEMA), 3).toPandas()
    assert got[got.component == 1].whitened.notna().all() and got[got.component > 1].whitened.isna().all()
    assert got[got.component == 1].explained.iloc[0] == pytest.approx(1) and (got[got.component > 1].explained == 0).all() and got.identity_error.max() < 1e-9


def test_deviations_beyond_64_bits_are_an_error(spark):
    rows = [(i, [(-1.0) ** i * 2.0**40], None, None, None) for i in range(4)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        whiten(spark.createDataFrame(rows, SCHEMA)).collect()
