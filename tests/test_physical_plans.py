"""Physical-plan properties the design relies on (pruning, pushdown, no Python)."""

import re

import pytest

import __spark_entry__ as E
from retentio.operators.split import assign_split
from retentio.sources.subscribers import load_subscribers
from retentio.workspace import workspace


def _plan(df) -> str:
    """The final adaptive plan after running ``df``."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_source_prunes_orders_and_aggregates_once(spark, sf_dir):
    plan = _plan(load_subscribers(spark, sf_dir))
    schemas = set(re.findall(r"orders\.parquet\], PartitionFilters: \[\], PushedFilters: \[[^\]]*\], ReadSchema: (struct<[^>]*>)", plan))
    assert schemas <= {"struct<o_custkey:bigint,o_orderdate:timestamp_ntz>", "struct<o_orderdate:timestamp_ntz>"}
    # one hash shuffle of per-customer partials; the last-date max is a global aggregate
    assert len(re.findall(r"Exchange hashpartitioning\(o_custkey", plan)) == 1


@pytest.mark.parametrize("name", ["churn_by_quartile", "clv_by_churn", "revenue_at_risk", "quartile_stats"])
def test_reports_prune_split_folders_and_columns(spark, sf_dir, name):
    plan = _plan(E.queries()[name](spark, sf_dir))
    # either a folder-pruned parquet scan, or (reports with a median) a scan of
    # the checkpointed (value, count) table that the pruned scan produced
    pruned = "PartitionFilters: [split" in plan or "PartitionFilters: [isnotnull(split" in plan
    checkpointed = re.findall(r"Scan ExistingRDD\[([^\]]*)\]", plan)
    assert pruned or checkpointed
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert len(schema.split(",")) <= 4, schema
    for cols in checkpointed:
        assert len(cols.split(",")) <= 4, cols


def test_collapse_before_median_prunes(spark, sf_dir):
    from retentio.workspace import workspace
    rows = workspace(spark, sf_dir).report_rows()
    collapsed = rows.where("CLV IS NOT NULL").groupBy("Churn", "CLV").count()
    plan = _plan(collapsed)
    assert "PartitionFilters: [split" in plan or "PartitionFilters: [isnotnull(split" in plan
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["Churn:int,CLV:double"]


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_relational_queries_run_no_python(spark, sf_dir, name):
    plan = _plan(E.queries()[name](spark, sf_dir))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan


def test_split_rank_is_not_a_single_task_window(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    plan = _plan(assign_split(ws.cleaned))
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)
    # every window over rows is partitioned by the class and a bucket
    assert any("_rt_bucket" in w and "Churn" in w for w in windows)
    assert not re.search(r"Exchange SinglePartition[^\n]*\n[^\n]*Window", plan)
