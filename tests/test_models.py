"""Model bands and invariants (rows without an exact oracle)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.ml.models import load, save
from retentio.ml.scoring import high_risk_check, score
from retentio.ml.treeshap import attributions
from retentio.operators import metrics as M
from retentio.workspace import workspace


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def trained(ws):
    return ws.trained()


def _scored(ws, model):
    return score(ws.split("test"), model, keep=("customer_id", "Churn"))


def test_auc_above_chance_and_probabilities_valid(ws, trained):
    s = _scored(ws, trained.combined())
    pdf = s.toPandas()
    for m in K.MODEL_NAMES:
        p = pdf[f"p_{m}"]
        assert ((p >= 0) & (p <= 1)).all()
    mean = pdf[[f"p_{m}" for m in K.MODEL_NAMES]].mean(axis=1)
    assert np.allclose(mean, pdf["churn_probability"])
    long = s.select(F.lit("logistic").alias("model"), F.col("Churn").alias("label"), F.col("p_logistic").alias("score"))
    assert M.auc(long).first().auc_roc > 0.6


def test_save_load_gives_same_scores(spark, ws, trained, tmp_path):
    from retentio.session import ensure_checkpoint_dir
    import os, uuid
    path = os.path.join(ensure_checkpoint_dir(spark), "test-models", uuid.uuid4().hex)
    save(trained, path)
    a = _scored(ws, trained.combined()).toPandas().sort_values("customer_id").reset_index(drop=True)
    b = _scored(ws, load(path)).toPandas().sort_values("customer_id").reset_index(drop=True)
    assert np.allclose(a["churn_probability"], b["churn_probability"])


def test_treeshap_sums_to_margin(spark, ws, trained):
    feats = trained.features.transform(ws.split("test")).select("customer_id", "features")
    att = attributions(feats.limit(40), trained.models["boosted"], "boosted").toPandas()
    sums = att["base_value"] + att["contributions"].apply(lambda a: float(np.sum(a)))
    assert np.allclose(sums, att["output"], atol=1e-6)
    probs = _scored(ws, trained.combined()).select("customer_id", "p_boosted").toPandas().set_index("customer_id")
    p = probs.loc[att["customer_id"], "p_boosted"].to_numpy()
    assert np.allclose(1 / (1 + np.exp(-att["output"].to_numpy())), p, atol=1e-6)


def test_forest_treeshap_sums_to_probability(spark, ws, trained):
    feats = trained.features.transform(ws.split("test")).select("customer_id", "features").limit(5)
    att = attributions(feats, trained.models["random_forest"], "forest").toPandas()
    sums = att["base_value"] + att["contributions"].apply(lambda a: float(np.sum(a)))
    assert np.allclose(sums, att["output"], atol=1e-6)
    probs = _scored(ws, trained.combined()).select("customer_id", "p_random_forest").toPandas().set_index("customer_id")
    assert np.allclose(att["output"], probs.loc[att["customer_id"], "p_random_forest"].to_numpy(), atol=1e-6)


def test_high_risk_check_shape(spark, ws):
    rows = high_risk_check(spark, ws.model(), ws.fitted_cut()).collect()
    assert {r.profile for r in rows} == {"HIGH_RISK", "LOW_RISK"}
    assert {r.model for r in rows} == {"logistic", "random_forest", "boosted", "ensemble"}


def test_stream_equals_batch(spark, ws):
    import __spark_entry__ as E
    streamed = E.queries()["stream_scores"](spark, "/root/testdata/sf0.01").toPandas()
    from retentio.ml.scoring import score_requests
    from retentio.functions.columns import to_number
    from retentio.schema import SCORING_REQUEST
    raw = ws.raw
    req = raw.select(F.col("customerID").alias("customer_id"),
                     *[F.col(f.name) for f in SCORING_REQUEST.fields[1:] if f.name != "TotalCharges"],
                     to_number("TotalCharges").alias("TotalCharges"))
    batch = score_requests(req, ws.model(), ws.fitted_cut()).toPandas()
    m = streamed.merge(batch, on="customer_id", suffixes=("_s", "_b"))
    assert len(m) == len(batch) == len(streamed) == ws.prepared.count()
    # a request has the features of the prepared table, so its scores too
    table = score(ws.prepared, ws.model()).toPandas()
    t = streamed.merge(table, on="customer_id", suffixes=("_s", "_t"))
    assert len(t) == len(table) and np.allclose(t["churn_probability_s"], t["churn_probability_t"], rtol=0, atol=1e-12)
    other = score_requests(req, ws.model(), serving_compat=True).toPandas()
    assert not np.allclose(other.sort_values("customer_id")["churn_probability"], table.sort_values("customer_id")["churn_probability"])
    with pytest.raises(ValueError):
        score_requests(req, ws.model())
    assert np.allclose(m["churn_probability_s"], m["churn_probability_b"])


def test_batch_kernel_equals_recursion(spark, ws, trained):
    from pyspark.ml.functions import vector_to_array
    from retentio.ml.treeshap import _leaf_paths, _tables, predict_batch, tree_shap, tree_shap_batch
    x = np.array([r.x for r in trained.features.transform(ws.split("test"))
                  .select(vector_to_array("features").alias("x")).limit(25).collect()])
    for name, kind in (("boosted", "boosted"), ("random_forest", "forest")):
        trees = _tables(spark, trained.models[name], kind)["trees"][:10]
        ref = np.zeros_like(x)
        for i in range(len(x)):
            for t in trees:
                tree_shap(x[i], t, ref[i])
        got = np.zeros_like(x)
        for t in trees:
            tree_shap_batch(x, t, got, _leaf_paths(t), {})
        assert np.allclose(ref, got, atol=1e-12)
        assert np.isfinite(sum(predict_batch(x, t) for t in trees)).all()
