"""Bad rows are set aside; batches of a stream count once."""

import os

import pytest
from pyspark.sql import functions as F

from retentio.schema import RAW_SUBSCRIBERS, SCORING_REQUEST
from retentio.sources import quarantine as N
from retentio.sources.files import read_raw_csv
from retentio.streaming.scoring import request_stream
from retentio.streaming.sink import CommitLog, read_committed, start_batches

GOOD = "7,Male,0,Yes,No,5,Yes,No,DSL,No,No,No,No,No,No,One year,Yes,Mailed check,50.5, ,No"


@pytest.fixture(scope="module")
def known(spark):
    rows = [(c, v) for c in N.CATEGORIES for v in ("Yes", "No", "DSL", "Male", "One year", "Mailed check")]
    return N.domains(spark.createDataFrame(rows, "column_name string, value string"))


def test_lines_that_do_not_parse(spark, tmp_path):
    header = ",".join(f.name for f in RAW_SUBSCRIBERS.fields)
    lines = [header, GOOD, GOOD.replace(",5,", ",five,", 1), "8,Male,0", GOOD.replace("7,", "9,", 1)]
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(lines) + "\n")
    good, bad = N.read_raw_csv_quarantined(spark, str(path))
    assert sorted(r.customerID for r in good.select("customerID").collect()) == ["7", "9"]
    rows = sorted(tuple(r) for r in bad.select("key", "line", "reasons").collect())
    assert rows == [("7", lines[2], [N.MALFORMED]), ("8", "8,Male,0", [N.MALFORMED])]
    with pytest.raises(Exception):
        read_raw_csv(spark, str(path)).collect()  # the batch path still fails


def test_reasons_name_every_fault(spark, known):
    base = {f.name: None for f in SCORING_REQUEST.fields}
    whole = base | {c: "Yes" for c in N.CATEGORIES} | {"customer_id": "a", "tenure": 3, "MonthlyCharges": 9.0}
    rows = [whole, whole | {"customer_id": "b", "Contract": "Weekly", "Partner": None}, whole | {"customer_id": "c", "tenure": -1, "MonthlyCharges": float("nan")},
            whole | {"customer_id": None, "MonthlyCharges": None}]
    df = spark.createDataFrame([tuple(r[f.name] for f in SCORING_REQUEST.fields) for r in rows], SCORING_REQUEST)
    good, bad = N.split_valid(df, known)
    assert [r.customer_id for r in good.collect()] == ["a"] and good.columns == df.columns
    assert {r.customer_id: sorted(r.reasons) for r in bad.collect()} == {
        "b": ["missing Partner", "unknown Contract: Weekly"], "c": ["missing MonthlyCharges", "negative tenure"], None: ["missing MonthlyCharges"]}
    good, bad = N.split_valid(df.where("false"), known)
    assert good.count() == bad.count() == 0
    plan = N.checked(df, known)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(column_name" in plan and "Python" not in plan


class Stop(Exception):
    pass


def test_a_stop_between_write_and_commit_neither_loses_nor_repeats(spark, tmp_path, monkeypatch):
    source, sink, log = (f"{tmp_path}/{d}" for d in ("in", "out", "log"))
    for i in range(4):
        spark.range(10 * i, 10 * i + 10).select(F.col("id").cast("string").alias("customer_id")).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: request_stream(spark, source, spark.read.parquet(source).schema, max_files_per_trigger=1)
    work = lambda batch: {"scored": batch, "rejected": batch.where("customer_id % 10 = 3")}
    add = CommitLog.add

    def stop_at_two(self, batch):
        if batch == 2:
            raise Stop("between write and commit")
        add(self, batch)

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "add", stop_at_two)
        with pytest.raises(Exception, match="between write and commit"):
            start_batches(stream(), sink, work, log).awaitTermination()
    assert os.path.isdir(f"{sink}/batch=2") and CommitLog(spark, sink).batches() == [0, 1]
    assert read_committed(spark, sink).count() == 20  # what is not committed is not seen
    start_batches(stream(), sink, work, log).awaitTermination()
    rows = [int(r.customer_id) for r in read_committed(spark, sink).collect()]
    assert sorted(rows) == list(range(40))
    assert read_committed(spark, sink, "rejected").count() == 4
    # a committed batch that comes again is skipped
    from retentio.streaming.sink import batch_writer
    batch_writer(spark, sink, work)(spark.range(5).select(F.col("id").cast("string").alias("customer_id")), 1)
    assert read_committed(spark, sink).count() == 40


def test_nothing_committed_yet(spark, tmp_path):
    assert read_committed(spark, f"{tmp_path}/none") is None
