"""Metrics taken while stages are written, and what closing a workspace leaves."""

import os
from urllib.parse import urlparse

import __spark_entry__ as E
from retentio.operators import quality as Q
from retentio.workspace import workspace

QUERIES = ("missing_profile", "total_conversions", "class_balance", "ratio_anomalies", "flag_totals", "balance_checks")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_observations_equal_the_scans(spark, sf_dir):
    ws, q = workspace(spark, sf_dir), E.queries()
    for name, scan in (("missing_profile", Q.missing_profile(ws.raw)), ("class_balance", Q.class_balance(ws.prepared)), ("flag_totals", Q.flag_totals(ws.prepared)),
                       ("ratio_anomalies", Q.ratio_anomalies(ws.prepared)), ("balance_checks", Q.balance_checks(ws.prepared))):
        assert _rows(q[name](spark, sf_dir)) == _rows(scan), name


def test_profiles_start_no_scan_of_the_tables(spark, sf_dir):
    workspace(spark, sf_dir).prepared
    for name in QUERIES:
        df = E.queries()[name](spark, sf_dir)
        files = df.inputFiles()
        assert files and all("/_observed/" in f for f in files), name
        assert "HashAggregate" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_conversions_count_every_total_once(spark, sf_dir):
    n = {r.conversion: r.customers for r in E.queries()["total_conversions"](spark, sf_dir).collect()}
    ws = workspace(spark, sf_dir)
    blank = ws.raw.where("trim(TotalCharges) = ''").count()
    assert n["totals_new_customer"] + n["totals_one_month"] == blank == n["totals_not_numeric"] > 0


def test_closing_leaves_published_tables_only(spark, sf_dir, monkeypatch):
    import retentio.plans.lineage as L
    from retentio.plans.store import Store

    monkeypatch.setattr(L, "_SCRATCH", {})  # the scratch of other tests stays
    ws = workspace(spark, sf_dir)
    kept = urlparse(ws._artifact("prepared", None, "_SUCCESS")).path
    path = L.scratch_path(spark, "test")
    spark.range(3).write.parquet(path)
    ws._store = Store(spark, f"{os.path.dirname(path)}/own-store", lease_s=0.5)
    spark.range(3).write.parquet(f"{ws._store.root}/k/data-dead")
    gone = {urlparse(g).path for g in ws.close()}
    assert gone == {urlparse(path).path, urlparse(f"{ws._store.root}/k/data-dead").path}
    assert not os.path.exists(urlparse(path).path) and os.path.exists(f"{kept}/_SUCCESS")
    ws._store = Store(spark)
    assert ws.prepared.count() > 0
