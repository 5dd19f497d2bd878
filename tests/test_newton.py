"""Batched Newton fits against MLlib, one fit at a time."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retentio.ml import newton
from retentio.ml.newton import Problem, fit_logistics, fold_moments, merge, scaling


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 5)) * [1.0, 30.0, 0.01, 1.0, 4.0] + [0.0, 1e4, 0.0, 2.0, 0.0]
    x[:, 3] = 2.0  # does not vary
    y = (r.random(600) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 1e4) / 30 - 0.5)))).astype(int)
    w = np.where(y == 1, 1.7, 0.6)
    data = [(Vectors.dense(v), int(c), float(q), i % 5) for i, (v, c, q) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(data, ["features", "y", "w", "fold"]).repartition(4).cache()


def test_equals_mllib(rows):
    problems = [Problem(f, reg) for f, reg in ((None, 0.0), (None, 1e-3), (3, 0.5))]
    fits = fit_logistics(rows, problems, "features", "y", "w")
    for p, fit in zip(problems, fits, strict=True):
        part = rows if p.fold is None else rows.where(F.col("fold") != p.fold)
        scaler = StandardScaler(inputCol="features", outputCol="s", withMean=True, withStd=True).fit(part)
        lr = LogisticRegression(featuresCol="s", labelCol="y", weightCol="w", standardization=False, regParam=p.reg, maxIter=200, tol=1e-12).fit(scaler.transform(part))
        assert np.allclose(fit.mean, scaler.mean.toArray())
        assert np.allclose(fit.beta[:-1], lr.coefficients.toArray(), atol=1e-6), p
        assert fit.beta[-1] == pytest.approx(lr.intercept, abs=1e-6)
        assert abs(fit.beta[3]) < 1e-12 and fit.scale[3] == 0.0


def test_all_problems_share_the_passes(rows, monkeypatch):
    calls = []
    inner = newton._evaluate
    monkeypatch.setattr(newton, "_evaluate", lambda *a: calls.append(len(a[-1])) or inner(*a))
    fit_logistics(rows, [Problem(f, 1e-2) for f in range(5)] * 4, "features", "y", "w")
    assert calls[0] == 20 and len(calls) <= 12


def test_moments_merge_like_the_whole(rows):
    moments = fold_moments(rows, "features", "fold")
    x = np.array([r.features.toArray() for r in rows.where("fold <> 2").collect()])
    mean, scale = scaling(moments, 2)
    assert np.allclose(mean, x.mean(axis=0), rtol=1e-14)
    some = x.std(axis=0, ddof=1) > 0
    assert np.allclose(scale[some], 1 / x.std(axis=0, ddof=1)[some], rtol=1e-9)
    empty = (0, np.zeros(5), np.zeros(5))
    assert merge(empty, moments[0])[0] == moments[0][0] and merge(empty, empty)[0] == 0


def test_separable_rows_and_a_fold_without_rows(spark):
    data = [(Vectors.dense([float(i)]), int(i >= 10), 1.0, i % 2) for i in range(20)]
    rows = spark.createDataFrame(data, ["features", "y", "w", "fold"])
    one, other = fit_logistics(rows, [Problem(None, 1e-4), Problem(4, 1e-4)], "features", "y", "w")
    assert np.isfinite(one.beta).all() and one.beta[0] > 1
    assert np.allclose(one.beta, other.beta)  # fold 4 has no rows: nothing is left out


def test_held_out_scores_cover_each_row_once(rows):
    fits = fit_logistics(rows, [Problem(f, 0.1) for f in range(5)], "features", "y", "w")
    scores = newton.held_out_scores(rows, {f"m/{f}": (f, fit) for f, fit in enumerate(fits)}, "features", "y")
    assert scores.count() == 600
    assert scores.where("score < 0 or score > 1").count() == 0
