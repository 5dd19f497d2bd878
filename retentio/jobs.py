"""Batch jobs that chain the operators and write their results.

``python -m retentio.jobs <prepare|train|report> <sf_dir> <out_dir> [grid]``

* prepare: the prepared table partitioned by ``split`` (IO3) and the
  codes table (IO4);
* train: fits the models on the train split, saves the combined scoring
  pipeline (IO5, IO6) and writes test metrics (IO7);
* report: writes the lifetime-value reports.

Every output is written under ``out_dir`` (shared storage on a cluster).
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.operators import metrics as M
from retentio.operators import reports as R
from retentio.operators.encode import codes_table
from retentio.sources.files import write_splits, write_table
from retentio.workspace import workspace


def prepare_job(spark: SparkSession, sf_dir: str, out: str) -> None:
    ws = workspace(spark, sf_dir)
    write_splits(ws.prepared, os.path.join(out, "prepared"))
    write_table(codes_table(spark, ws.codes), os.path.join(out, "codes"))
    write_table(ws.cuts, os.path.join(out, "cuts"))


def train_job(spark: SparkSession, sf_dir: str, out: str, grid: str = "reference") -> None:
    from retentio.ml.models import save
    from retentio.ml.scoring import score

    ws = workspace(spark, sf_dir)
    trained = ws.trained(grid)
    save(trained, os.path.join(out, "model"), ws.cuts)
    scored = score(ws.split("test"), trained.combined(), keep=("customer_id", "Churn"))
    items = [F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("score")) for m in K.MODEL_NAMES]
    items.append(F.struct(F.lit("ensemble").alias("model"), F.col("churn_probability").alias("score")))
    long = scored.select(F.col("Churn").alias("label"), F.explode(F.array(*items)).alias("s")).select(
        "s.model", "label", "s.score")
    counts = M.score_counts(long)  # one pass over the scored rows for every metric
    metrics = M.classification_metrics(counts).join(M.confusion_matrix(counts), "model")
    write_table(metrics, os.path.join(out, "metrics"))
    write_table(M.roc_curve(counts), os.path.join(out, "roc"))


def report_job(spark: SparkSession, sf_dir: str, out: str) -> None:
    ws = workspace(spark, sf_dir)
    rows = ws.report_rows()
    for name, df in {
        "clv_by_churn": R.clv_by_churn(rows), "churn_by_quartile": R.churn_by_quartile(rows),
        "revenue_at_risk": R.revenue_at_risk(rows), "quartile_stats": R.quartile_stats(rows),
        "clv_histogram": R.clv_histogram(rows), "business_insights": R.business_insights(rows),
        "retention_priority": R.retention_priority(ws.prepared),
    }.items():
        write_table(df, os.path.join(out, "reports", name))


def main(argv: list[str]) -> int:
    if len(argv) < 3:
        print(__doc__)
        return 2
    job, sf_dir, out = argv[:3]
    # the submitted settings hold: master, partitions and memory are not set here
    spark = SparkSession.builder.appName("retentio").getOrCreate()
    if job == "prepare":
        prepare_job(spark, sf_dir, out)
    elif job == "train":
        train_job(spark, sf_dir, out, argv[3] if len(argv) > 3 else "reference")
    elif job == "report":
        report_job(spark, sf_dir, out)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
