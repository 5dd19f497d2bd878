"""Explanations and attributions of trained models read every row they are about."""

import numpy as np
import pytest

import __spark_entry__ as E
from retentio.ml.treeshap import attributions
from retentio.workspace import workspace

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, SF)


def test_forest_global_attribution_reads_every_training_row(spark, ws):
    query = E.queries()["forest_global_attribution"]
    feats = ws.trained().features.transform(ws.split("train")).select("customer_id", "features")
    each = np.array([r.contributions for r in attributions(feats, ws.trained().models["random_forest"], "forest").collect()])
    assert len(each) == ws.split("train").count() > 100
    got = {r.feature: r.mean_abs_attribution for r in query(spark, SF).collect()}
    from retentio import constants as K
    assert np.allclose([got[f] for f in K.FEATURE_COLUMNS], np.abs(each).mean(0), atol=2e-6)
    sampled = {r.feature: r.mean_abs_attribution for r in query(spark, SF, rows=100).collect()}
    assert set(sampled) == set(got) and sampled != got


def test_every_customer_is_explained_for_every_model(spark, ws):
    customers = {r.customer_id for r in ws.prepared.select("customer_id").collect()}
    for name in ("logistic_explanations", "boosted_explanations", "forest_explanations"):
        rows = E.queries()[name](spark, SF).collect()
        assert len(rows) == len(customers) and {r.customer_id for r in rows} == customers, name
        assert all(len(r.top_factors) == 5 for r in rows), name
    for name, each in (("logistic_top_factors", 5), ("all_top_factors", 5), ("all_linear_contributions", 27)):
        counts = {r.customer_id: r["count"] for r in E.queries()[name](spark, SF).groupBy("customer_id").count().collect()}
        assert counts == dict.fromkeys(customers, each), name
    got = {r.feature: r.mean_abs_contribution for r in E.queries()["all_global_contributions"](spark, SF).collect()}
    pdf = E.queries()["all_linear_contributions"](spark, SF).groupBy("feature").avg("abs_contribution").collect()
    assert len(got) == 27 and all(abs(got[r.feature] - r[1]) < 2e-6 for r in pdf)
