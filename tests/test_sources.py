"""Sources: fixed schemas, CSV round trip, split files, workspace reuse."""

import os

from pyspark.sql import functions as F

from retentio.operators.prepare import clean
from retentio.schema import RAW_SUBSCRIBERS
from retentio.session import ensure_checkpoint_dir
from retentio.sources.files import read_raw_csv, read_split, write_raw_csv, write_splits
from retentio.sources.subscribers import load_subscribers
from retentio.workspace import workspace


def test_raw_schema_is_fixed(spark, sf_dir):
    raw = load_subscribers(spark, sf_dir)
    assert [(f.name, f.dataType) for f in raw.schema.fields] == [(f.name, f.dataType) for f in RAW_SUBSCRIBERS.fields]


def test_blank_totals_and_new_customers_present(spark, sf_dir):
    raw = load_subscribers(spark, sf_dir)
    assert raw.where(F.col("TotalCharges") == " ").count() > 0
    assert raw.where(F.col("tenure") == 0).count() > 0
    cleaned = clean(raw)
    assert cleaned.where(F.col("TotalCharges").isNull()).count() == 0


def test_csv_round_trip_keeps_blanks(spark, sf_dir, tmp_path):
    raw = load_subscribers(spark, sf_dir)
    path = str(tmp_path / "raw_csv")
    write_raw_csv(raw, path)
    back = read_raw_csv(spark, path)
    assert [(f.name, f.dataType) for f in back.schema.fields] == [(f.name, f.dataType) for f in RAW_SUBSCRIBERS.fields]
    assert back.where(F.col("TotalCharges") == " ").count() == raw.where(F.col("TotalCharges") == " ").count()
    assert clean(back).exceptAll(clean(raw)).count() == 0


def test_split_files_prune_by_folder(spark, sf_dir, tmp_path):
    ws = workspace(spark, sf_dir)
    path = str(tmp_path / "prepared")
    write_splits(ws.prepared, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("split=")) == ["split=test", "split=train", "split=val"]
    train = read_split(spark, path, "train")
    plan = train.select("customer_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert train.count() == ws.split("train").count()


def test_workspace_artifacts_shared_across_sessions(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    n = ws.prepared.count()
    other = spark.newSession()
    ws2 = workspace(other, sf_dir)
    assert ws2 is not ws
    assert ws2._paths is ws._paths
    assert ws2.prepared.count() == n
    assert ws2.prepared.inputFiles()[0].startswith(ws.prepared.inputFiles()[0].rsplit("/", 2)[0])


def test_checkpoint_dir_comes_from_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
