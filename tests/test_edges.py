"""Null keys, classes and strata, single-class models, and settings that must hold on a cluster."""

import re

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from retentio.operators import metrics as M
from retentio.operators.split import assign_split
from retentio.plans.ordered import running_totals, with_numeric_bucket
from retentio.plans.quantiles import quantiles
from retentio.session import ensure_checkpoint_dir, local_session


def test_split_keeps_rows_without_key_or_class(spark):
    df = spark.range(100).select(
        F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("customer_id"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 2).cast("int")).alias("Churn"),
    )
    out = assign_split(df)
    assert out.count() == 100 and out.where("split IS NULL").count() == 0
    by_class = {r.Churn: r.n for r in out.where("split = 'test'").groupBy("Churn").agg(F.count("*").alias("n")).collect()}
    sizes = {r.Churn: r["count"] for r in df.groupBy("Churn").count().collect()}
    assert by_class == {k: (n + 4) // 5 for k, n in sizes.items()}


def test_null_stratum_has_totals_and_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 4.0), ("a", 9.0)], "s string, v double")
    totals = running_totals(df, ["v"], {"c": F.lit(1).cast("long")}, strata=["s"])
    assert sorted((str(r.s), r.v, r.c) for r in totals.collect()) == [("None", 1.0, 1), ("None", 3.0, 2), ("a", 2.0, 1), ("a", 4.0, 2), ("a", 9.0, 3)]
    assert {r.s: r.q0 for r in quantiles(df, "v", [0.5], strata=["s"]).collect()} == {None: 2.0, "a": 4.0}


@pytest.mark.parametrize("partitions", [200, 1000])
def test_bucket_lookup_stays_in_generated_code(spark, partitions):
    """Four buckets a partition: small code, compiled, and equal to a binary search."""
    df = spark.range(20_000).select("id", (F.xxhash64("id") % 10_000 / 7.0).alias("v"))
    bucketed = with_numeric_bucket(df, "v", "b", 4 * partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it is compiled
    try:
        rows = bucketed.agg(F.sum("b"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    code = rows._jdf.queryExecution().debug().codegenToSeq()
    sizes = [int(code.apply(i)._3().maxMethodCodeSize()) for i in range(code.size())]
    assert sizes and max(sizes) < 8000
    assert not re.search(r"^\s*\+- Project", plan, re.M)  # every projection is inside a generated stage
    pdf = bucketed.toPandas().sort_values("v")
    assert pdf["b"].is_monotonic_increasing and pdf["b"].nunique() > 2 * partitions


def test_bucket_of_nulls_and_one_value(spark):
    df = spark.createDataFrame([(None,), (5.0,), (5.0,), (7.0,)], "v double")
    got = {r.v: r.b for r in with_numeric_bucket(df, "v", "b", 4).collect()}
    assert got[None] == 0 and got[5.0] <= got[7.0]
    assert [r.b for r in with_numeric_bucket(df.where("v IS NULL"), "v", "b", 4).collect()] == [0]


def test_single_class_model_gives_null_not_an_error(spark):
    rows = [("one", 1, 0.2), ("one", 1, 0.8), ("two", 1, 0.9), ("two", 0, 0.1), ("two", 0, 0.9)]
    df = spark.createDataFrame(rows, "model string, label int, score double")
    got = {r.model: r for r in M.classification_metrics(df).collect()}
    assert got["one"].auc_roc is None and got["two"].auc_roc == pytest.approx(0.75)
    curve = M.roc_curve(df).collect()
    assert all(r.fpr is None for r in curve if r.model == "one")
    assert [(r.fpr, r.tpr) for r in curve if r.model == "two" and r.threshold is None] == [(0.0, 0.0)]


class _Elsewhere:
    """The parts of a session that the checkpoint rule looks at."""

    class sparkContext:  # noqa: N801
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Elsewhere)


def test_local_session_takes_the_active_one(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert local_session(2) is spark or local_session(2).sparkContext is spark.sparkContext
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_jobs_keep_the_submitted_settings(spark, monkeypatch, tmp_path):
    from retentio import jobs

    seen = {}
    monkeypatch.setattr(jobs, "report_job", lambda s, sf, out: seen.update(master=s.sparkContext.master, session=s))
    assert jobs.main(["report", "x", str(tmp_path)]) == 0
    assert seen["master"] == spark.sparkContext.master == SparkSession.getActiveSession().sparkContext.master


def test_missing_input_is_an_error(spark, tmp_path):
    from retentio.workspace import _signature

    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        _signature(spark, str(tmp_path))


def test_quantiles_unchanged_by_the_lookup(spark):
    v = np.round(np.random.default_rng(2).normal(size=5000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    row = quantiles(df, "v", [0.1, 0.5, 0.99]).first()
    assert np.allclose(list(row), np.quantile(v, [0.1, 0.5, 0.99]))
