"""The tree search's fits against brute force and against the final learners."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.ml import tree_search as T
from retentio.ml.models import best_point, grid_points


def _rows(n=400, seed=0):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.integers(0, 4, (n, 2)).astype(float), r.normal(size=(n, 3))], axis=1)
    p = 1 / (1 + np.exp(-(x[:, 2] + np.where(x[:, 0] == 2, 2.0, -1.0) + x[:, 3] * x[:, 4])))
    y = (r.random(n) < p).astype(float)
    flags = np.array([True, True, False, False, False])
    return T.Rows(T.binned(x, flags), y, np.arange(n) % 5, r.random(n) + 0.5, np.where(y == 1, 2.0, 1.0), flags)


def test_auc_counts_pairs():
    label, score = np.array([1, 0, 1, 0, 0, 1.0]), np.array([0.9, 0.9, 0.4, 0.4, 0.1, 0.7])
    pairs = [(a > b) + (a == b) / 2 for a, b in itertools.product(score[label == 1], score[label == 0])]
    assert T.auc(label, score) == pytest.approx(np.mean(pairs))
    assert T.auc(np.ones(3), np.arange(3.0)) is None


def test_first_split_is_the_best_of_all():
    rows = _rows(120)
    fit = np.arange(120)
    w, s = rows.balanced, rows.balanced * rows.label
    out, _ = T.grow(rows, fit, np.zeros(120, np.int64), w, s, np.ones(120), 1, fit, 1, 5, [0, 1])
    best = -np.inf
    for j in range(5):
        values = np.unique(rows.bins[:, j])
        subsets = [c for k in range(1, len(values)) for c in itertools.combinations(values, k)] if rows.categorical[j] else [values[:k] for k in range(1, len(values))]
        for chosen in subsets:
            left = np.isin(rows.bins[:, j], chosen)
            if min(left.sum(), (~left).sum()) >= 5:
                best = max(best, s[left].sum() ** 2 / w[left].sum() + s[~left].sum() ** 2 / w[~left].sum())
    assert out[0] == pytest.approx(np.full(120, s.sum() / w.sum()))
    assert (w * out[1] ** 2).sum() == pytest.approx(best)  # the gain of the two means


@pytest.mark.parametrize("min_leaf", [1, 4])
def test_a_cut_tree_is_the_shallower_tree(min_leaf):
    rows, fit = _rows(), np.arange(300)
    held = np.arange(300, 400)
    args = (rows, fit, np.zeros(300, np.int64), rows.balanced[fit], (rows.balanced * rows.label)[fit], np.ones(300), 1, held)
    deep, _ = T.grow(*args, 12, min_leaf, [2, 5, 12])
    for i, depth in enumerate((2, 5, 12)):
        shallow, _ = T.grow(*args, depth, min_leaf, [depth])
        assert np.allclose(deep[i], shallow[0])


def test_slices_and_groups_do_not_change_a_tree(monkeypatch):
    rows, fit = _rows(), np.arange(400)
    args = (rows, np.tile(fit, 3), np.repeat(np.arange(3), 400), np.tile(rows.balanced, 3), np.tile(rows.balanced * rows.label, 3), np.ones(1200), 3, fit, 6, 1, [6])
    whole, own = T.grow(*args)
    monkeypatch.setattr(T, "SLICE", 2)
    parts, mine = T.grow(*args)
    assert np.allclose(whole, parts) and np.allclose(own, mine)
    assert np.allclose(own.reshape(3, 400).sum(axis=0), whole[0])


def test_scores_beat_chance_and_one_class_has_no_auc():
    rows = _rows(1000)
    for job in (T.Job("boosted", 1, (3,), 1, 0.1), T.Job("random_forest", 1, (3, 10), 2)):
        found = T.run_job(rows, job, 30, 40, 42)
        assert [f[1] for f in found] == list(job.depths)
        assert all(f[5] > 0.7 and f[6:8] == (800, 200) for f in found)
    flat = T.Rows(rows.bins, np.zeros(1000), rows.fold, rows.balanced, rows.boost, rows.categorical)
    assert T.run_job(flat, T.Job("boosted", 1, (3,), 1, 0.1), 5, 5, 1)[0][5] is None
    assert T.run_job(rows, T.Job("boosted", 9, (3,), 1, 0.1), 5, 5, 1)[0][7] == 0


def test_many_values_and_many_categories():
    x = np.random.default_rng(1).normal(size=(5000, 1))
    assert T.binned(x, np.array([False])).max() < T.BINS
    with pytest.raises(ValueError):
        T.binned(np.arange(40.0)[:, None], np.array([True]))


def test_best_point_takes_the_first_of_equals():
    points = [{"c": 1.0}, {"c": 2.0}, {"c": 3.0}]
    rows = [{"point": p, "fold": f, "auc": a} for p, a in zip(points, (0.7, 0.8, 0.8), strict=True) for f in range(5)]
    assert best_point(rows, points) == ({"c": 2.0}, pytest.approx(0.8))
    assert best_point([{"point": points[0], "fold": 0, "auc": None}], points)[0] == points[0]


def test_published_grids():
    assert len(grid_points("logistic")) == 4 and len(grid_points("random_forest")) == 12 and len(grid_points("boosted")) == 9


def test_search_agrees_with_the_final_learner(spark):
    """The boosted fit of a task and pyspark.ml's on the same fold rank the held-out rows alike."""
    from pyspark.ml.functions import vector_to_array

    from retentio.ml import models as M
    from retentio.workspace import workspace

    ws = workspace(spark, "/root/testdata/sf0.01")
    train = M.with_weights(ws.split("train"))
    train = ws.trained().features.transform(train).select(M.FEATURES, M.LABEL, "fold", M.W_BALANCED, M.W_BOOST).coalesce(1).cache()
    flags = [c in K.STRING_FEATURES for c in K.FEATURE_COLUMNS]
    rows = T.collect_rows(train, M.FEATURES, M.LABEL, M.W_BALANCED, M.W_BOOST, flags)
    mine = T.run_job(rows, T.Job("boosted", 0, (3,), 1, 0.1), 1, 20, K.SEED)[0][5]
    model = M.boosted_estimator().setMaxDepth(3).setStepSize(0.1).setMaxIter(20).fit(train.where("fold <> 0"))
    held = model.transform(train.where("fold = 0")).select(F.col(M.LABEL).alias("y"), vector_to_array("prob_boosted")[1].alias("p")).toPandas()
    assert mine == pytest.approx(T.auc(held["y"].to_numpy(), held["p"].to_numpy()), abs=0.02)


def test_the_registered_form_of_the_search(spark):
    """The published grids in full, as the registered queries run them, on the smallest table."""
    from retentio.workspace import workspace

    ws = workspace(spark, "/root/testdata/sf0.001")
    found = ws.search("reference")
    assert found.count() == 125
    best = {r.model: r.n for r in found.where("chosen").groupBy("model").agg(F.countDistinct("point").alias("n")).collect()}
    assert best == dict.fromkeys(K.MODEL_NAMES, 1)
    assert {type(s).__name__ for s in ws.model("reference").stages} >= {"LogisticRegressionModel", "RandomForestClassificationModel", "GBTClassificationModel"}
