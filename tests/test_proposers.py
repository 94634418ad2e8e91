import numpy as np
import pytest

from trainloom.operators import models, proposers


def frame(spark, x, group=1, start=0):
    return spark.createDataFrame([(start + i, group, [float(v) for v in row]) for i, row in enumerate(x)], "i long, g long, x array<double>")


def test_whitening(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 3, (60, 4))
    x[:, 1] = 7.0
    x[rng.random(60) < 0.7, 2] = np.nan
    x[:10, 3] = np.nan
    got = np.array([r["x"] for r in proposers.whitened(frame(spark, x).repartition(4), "g", "i", "x").orderBy("i").collect()])
    want = [(x[:, j] - np.nanmean(x[:, j])) / np.nanstd(x[:, j], ddof=1) for j in (0, 3)]
    assert np.allclose(got, np.nan_to_num(np.array(want).T))


def test_outliers(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(30, 1, (12, 3))])
    rows = frame(spark, x).unionByName(frame(spark, rng.normal(0, 1, (40, 3)) * 50, 2, 1000)).repartition(5)
    found = {r["i"] for r in proposers.outliers(rows, "g", "i").collect()}
    mean, cov = x.mean(axis=0), np.cov(x.T) + 1e-6 * np.eye(3)
    far = proposers.distances(x, (mean, np.linalg.inv(cov))) > proposers.tail_limit(3, 1e-3)
    mean, cov = x[~far].mean(axis=0), np.cov(x[~far].T) + 1e-6 * np.eye(3)
    far = proposers.distances(x, (mean, np.linalg.inv(cov))) > proposers.tail_limit(3, 1e-3)
    assert found == set(np.flatnonzero(far).tolist()) and set(range(400, 412)) <= found
    assert models.chi2_tail(proposers.tail_limit(5, 1e-3), 5) == pytest.approx(1e-3)


def test_robust_boundary(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (900, 2)), rng.normal(0, 6, (250, 2))])
    rng.shuffle(x)
    rows = frame(spark, x).unionByName(frame(spark, rng.normal(0, 1, (500, 2)), 2, 5000)).repartition(5)
    for most in (5000, 400):
        found = proposers.robust_boundaries(rows, "g", "i", most).collect()
        assert {r["g"] for r in found} == {1} and 120 <= len(found) <= 260 and found[0]["inflation"] > 10 and found[0]["gain"] > 10
        radius = np.hypot(*x[[r["i"] for r in found]].T)
        assert radius.min() > 2


def test_cuts_of_an_axis(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, 500), rng.normal(10, 1, 300)])
    (cut, gain), = proposers.crossings(v)
    assert 4 < cut < 6 and gain > 100 and proposers.crossings(rng.normal(0, 1, 500)) == [] and proposers.crossings(v[:50]) == []
    rows = spark.createDataFrame([(i, 1, float(x)) for i, x in enumerate(v)], "i long, g long, v double")
    (r,) = proposers.axis_cuts(rows, "g", "i", "v", 300).collect()
    assert (r["below"], r["n"]) == (500, 800)


def test_assignment_and_ridge():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (200, 2)), rng.normal(8, 1, (200, 2))])
    fit = models.diagonal_mixture(x, 2)
    best, posterior, far = proposers.assigned(np.array([*fit["means"], fit["means"].mean(axis=0)]), fit)
    assert best[0] != best[1] and (posterior[:2] > 0.99).all() and far[:2] == pytest.approx([0, 0]) and far[2] > 5
    assert proposers.noise_precision(np.zeros((2, 2))) is None and proposers.noise_precision(np.eye(2)) == pytest.approx(np.eye(2) / 1.01)
    y = np.stack([x @ [1.0, 2.0] + 3, np.ones(400)], axis=1)
    w, b = models.ridge_fit(x, y, 1e-9)
    assert proposers.ridge_r2(w, b, x, y) == pytest.approx([1, 0], abs=1e-6)
