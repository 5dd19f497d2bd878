"""Distributed running totals and exact quantiles against pandas / numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentio.plans.ordered import hash_bucket, numeric_bucket, ordinal_rank, running_totals
from retentio.plans.quantiles import quantiles


def _frame(spark, n=2000, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.gamma(2.0, 10.0, n), 3)
    v[: n // 3] = 5.0  # one value holds a third of the rows
    s = rng.integers(0, 3, n)
    w = rng.integers(0, 5, n)
    pdf = pd.DataFrame({"v": v, "s": s.astype(int), "w": w.astype(int)})
    return pdf, spark.createDataFrame(pdf)


def test_running_totals_match_pandas(spark):
    pdf, df = _frame(spark)
    distinct = df.groupBy("s", "v").agg(F.sum("w").alias("w"))
    got = running_totals(distinct, ["v"], {"cum": "w"}, strata=["s"]).toPandas()
    exp = pdf.groupby(["s", "v"], as_index=False)["w"].sum().sort_values(["s", "v"])
    exp["cum"] = exp.groupby("s")["w"].cumsum()
    m = got.merge(exp, on=["s", "v"], suffixes=("", "_e"))
    assert len(m) == len(exp)
    assert (m["cum"] == m["cum_e"]).all()


def test_ordinal_rank_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 2).alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    ranked = ordinal_rank(df, ["h", "id"], strata=["k"], name="r", bucket=hash_bucket("h", 16)).toPandas()
    for _, g in ranked.groupby("k"):
        assert sorted(g["r"]) == list(range(len(g)))
        assert list(g.sort_values("h")["r"]) == list(range(len(g)))


def test_numeric_bucket_is_monotone(spark):
    _, df = _frame(spark)
    b = numeric_bucket(df, "v", buckets=16)
    pdf = df.select("v", b.alias("b")).toPandas().sort_values("v")
    assert pdf["b"].is_monotonic_increasing


@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 0.75, 1.0], [0.1, 0.33, 0.9]])
def test_exact_quantiles_match_numpy_linear(spark, probs):
    pdf, df = _frame(spark)
    row = quantiles(df, "v", probs).first()
    exp = np.quantile(pdf["v"].to_numpy(), probs, method="linear")
    assert np.allclose([row[f"q{i}"] for i in range(len(probs))], exp, rtol=0, atol=1e-9)


def test_exact_quantiles_by_stratum(spark):
    pdf, df = _frame(spark)
    got = {r.s: r.q0 for r in quantiles(df, "v", [0.5], strata=["s"], strata_bound=3).collect()}
    for s, g in pdf.groupby("s"):
        assert got[s] == pytest.approx(float(np.median(g["v"])), abs=1e-9)


def test_quantiles_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,)], "v double")
    assert quantiles(df, "v", [0.5]).first().q0 == 2.0


def test_approximate_quantiles_close(spark):
    pdf, df = _frame(spark)
    row = quantiles(df, "v", [0.25, 0.5, 0.75], exact=False).first()
    exp = np.quantile(pdf["v"].to_numpy(), [0.25, 0.5, 0.75])
    span = pdf["v"].max() - pdf["v"].min()
    assert all(abs(row[f"q{i}"] - e) <= 0.02 * span for i, e in enumerate(exp))


def test_binned_auc_close_to_exact(spark):
    from retentio.operators.metrics import auc
    rng = np.random.default_rng(3)
    n = 4000
    label = rng.integers(0, 2, n)
    score = np.clip(0.35 * label + rng.normal(0.3, 0.2, n), 0, 1)
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "label": label.astype(int), "score": score}))
    exact = auc(df).first().auc_roc
    binned = auc(df, bins=1000).first().auc_roc
    pos, neg = score[label == 1], score[label == 0]
    ref = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert exact == pytest.approx(ref, abs=1e-12)
    assert abs(binned - exact) < 2e-3


@pytest.mark.parametrize("bins", [(4096, 4096), (4, 1)])
def test_selection_by_counting_is_exact(spark, monkeypatch, bins):
    """Ranks found by counting: negative, tiny, huge, infinite and equal values, strata with nulls, and few bins."""
    import retentio.plans.quantiles as Q
    monkeypatch.setattr(Q, "BINS", bins[0])
    monkeypatch.setattr(Q, "FINAL", bins[1])
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=300), r.lognormal(3, 5, 300), -r.lognormal(0, 9, 200), np.full(400, 7.25), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1e-300]])
    s = [("a", "b", None)[i % 3] for i in range(len(v))]
    df = spark.createDataFrame([(k, float(x)) for k, x in zip(s, v)], "s string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 0.999, 1.0]
    whole = quantiles(df, "v", probs).first()
    assert np.allclose([whole[f"q{i}"] for i in range(len(probs))], np.quantile(v, probs), rtol=1e-12, atol=0)
    for row in quantiles(df, "v", probs, strata=["s"]).collect():
        part = np.array([x for k, x in zip(s, v) if k == row.s])
        assert np.allclose([row[f"q{i}"] for i in range(len(probs))], np.quantile(part, probs), rtol=1e-12, atol=0)
    one = quantiles(spark.createDataFrame([(float("inf"), 3), (1.0, 1), (float("nan"), 2)], "v double, w long"), "v", [0.0, 0.2, 1.0], weight="w").first()
    assert one.q0 == 1.0 and one.q1 == float("inf") and np.isnan(one.q2)
    assert quantiles(df.where("false"), "v", [0.5]).first().q0 is None
    assert quantiles(df.where("false"), "v", [0.5], strata=["s"]).count() == 0


def test_selection_has_no_window_sort_or_nested_loop(spark, monkeypatch):
    import retentio.plans.quantiles as Q
    plans = []
    inner = Q.checkpoint
    monkeypatch.setattr(Q, "checkpoint", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or inner(d))
    monkeypatch.setattr(Q, "FINAL", 10)
    df = spark.range(0, 5000).select((F.col("id") * 1.25).alias("v"), (F.col("id") % 2).alias("s"))
    out = quantiles(df, "v", [0.25, 0.5], strata=["s"], strata_bound=2)
    out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert 2 <= len(plans) <= 4
    for plan in plans:
        assert "Window" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
