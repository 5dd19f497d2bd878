"""Batch jobs write their tables (IO3, IO4, reports)."""

import os

from retentio.jobs import prepare_job, report_job


def test_prepare_and_report_jobs(spark, sf_dir, tmp_path):
    out = str(tmp_path / "out")
    prepare_job(spark, sf_dir, out)
    report_job(spark, sf_dir, out)
    assert {d for d in os.listdir(os.path.join(out, "prepared")) if d.startswith("split=")} == {
        "split=train", "split=val", "split=test"}
    codes = spark.read.parquet(os.path.join(out, "codes"))
    assert codes.where("column_name = 'Contract'").count() == 3
    q = spark.read.parquet(os.path.join(out, "reports", "churn_by_quartile"))
    assert q.count() == 4
    assert spark.read.parquet(os.path.join(out, "cuts")).count() == 1


def test_train_job_writes_model_constants_and_metrics(spark, sf_dir, tmp_path):
    from retentio.jobs import train_job
    from retentio.ml.models import fitted_cut, load

    out = str(tmp_path / "out")
    train_job(spark, sf_dir, out, "quick")
    assert load(os.path.join(out, "model")).stages
    assert fitted_cut(spark, os.path.join(out, "model")) > 0
    metrics = spark.read.parquet(os.path.join(out, "metrics"))
    assert {r.model for r in metrics.collect()} == {"logistic", "random_forest", "boosted", "ensemble"}
    starts = spark.read.parquet(os.path.join(out, "roc")).where("threshold IS NULL").collect()
    assert len(starts) == 4 and all((r.fpr, r.tpr) == (0.0, 0.0) for r in starts)
