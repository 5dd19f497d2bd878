"""Tree models as node relations: groups of whole trees, explanations without the driver, fallbacks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.ml import fixed_trees, nodes, treeshap
from retentio.ml.explain import explanation, fallback_array, global_tree_attribution, tree_explanations
from retentio.ml.scoring import score
from retentio.workspace import workspace


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, "/root/testdata/sf0.001")


def test_groups_hold_whole_trees(spark, ws, monkeypatch):
    path = ws.trained().nodes["random_forest"]
    whole = [t for g in nodes.tree_groups(path) for t in g]
    assert len(whole) == K.FOREST_TREES == spark.read.parquet(path).select("tree").distinct().count()
    small = list(nodes.tree_groups(path, 50))
    assert len(small) > 3 and sum(map(len, small)) == len(whole)
    for a, b in zip(whole, (t for g in small for t in g), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a[:4], b[:4])) and a[4] == b[4]


def test_a_model_too_large_to_keep_is_read_group_by_group(ws, monkeypatch):
    path = ws.trained().nodes["boosted"]
    x = np.array([r.x for r in ws.encoded.select(fixed_trees.feature_vector().alias("x")).limit(20).collect()])
    out, phi = treeshap.Explainer(path)(x)
    monkeypatch.setattr(treeshap, "KEPT_NODES", 10)
    again = treeshap.Explainer(path)
    assert again.kept is None
    for _ in range(2):
        o, p = again(x)
        assert np.array_equal(o, out) and np.array_equal(p, phi)
    assert np.allclose(again.base + phi.sum(axis=1), out)


def test_rows_that_cannot_be_explained_get_the_fallback(spark, ws):
    trained = ws.trained()
    rows = score(ws.prepared, ws.model(), features=True).limit(6).select("customer_id", "p_boosted", "clv", "features")
    from pyspark.ml.functions import vector_to_array
    arrays = rows.select("customer_id", "p_boosted", "clv", vector_to_array("features").alias("features"))
    first = arrays.agg(F.min("customer_id")).first()[0]
    broken = arrays.withColumn("features", F.when(F.col("customer_id") == first, F.transform("features", lambda x, i: F.when(i == 4, float("nan")).otherwise(x))).otherwise(F.col("features")))
    factors = tree_explanations(broken, trained, "boosted", carry=("p_boosted", "clv"))
    out = {r.customer_id: r for r in explanation(factors, "p_boosted", fallback_array(trained, "boosted")).collect()}
    assert len(out) == 6
    assert {f.direction for f in out[first].top_factors} == {"affects"} and len(out[first].top_factors) == K.TOP_FACTORS
    assert all({f.direction for f in r.top_factors} <= {"increases", "decreases"} for c, r in out.items() if c != first)
    nulls = arrays.withColumn("features", F.lit(None).cast("array<double>"))
    assert all(r.top_factors is None for r in tree_explanations(nulls, trained, "boosted").collect())


def test_explanations_need_no_join_and_no_driver(spark, ws):
    import __spark_entry__ as E
    for name in ("boosted_explanations", "forest_explanations", "logistic_explanations"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan, name


def test_global_attribution_equals_the_mean_of_all_rows(ws):
    trained = ws.trained()
    feats = trained.features.transform(ws.split("train")).select("customer_id", "features")
    got = {r.feature: r.mean_abs_attribution for r in global_tree_attribution(feats, trained, "boosted").collect()}
    each = treeshap.attributions(feats, trained.models["boosted"], "boosted").toPandas()
    want = np.abs(np.stack(each["contributions"])).mean(axis=0)
    assert np.allclose([got[f] for f in K.FEATURE_COLUMNS], want)


def test_high_risk_check_of_the_published_search(spark, ws):
    """C4: every model has an answer for both profiles, and the floor decides whether it passes."""
    from retentio.ml.scoring import high_risk_check
    rows = high_risk_check(spark, ws.model("reference"), ws.fitted_cut("reference")).collect()
    of = {(r.profile, r.model): r for r in rows}
    assert len(of) == 2 * (len(K.MODEL_NAMES) + 1)
    for m in (*K.MODEL_NAMES, "ensemble"):
        assert of["HIGH_RISK", m].passed == (of["HIGH_RISK", m].probability >= 0.60)
        assert 0 <= of["LOW_RISK", m].probability <= 1 and of["LOW_RISK", m].passed is None
