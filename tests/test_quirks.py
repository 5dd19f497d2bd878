"""Edge cases: equal quartile edges, one class only, unseen values."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from retentio.operators import reports as R
from retentio.operators.encode import encode, fit_codes
from retentio.operators.prepare import clv_cuts


def _clv(spark, values, churn=None):
    churn = churn or [0] * len(values)
    return spark.createDataFrame(
        [(str(i), v, c, "Month-to-month") for i, (v, c) in enumerate(zip(values, churn))],
        "customer_id string, MonthlyCharges double, Churn int, Contract string",
    ).withColumn("CLV", F.col("MonthlyCharges") * 12)


def test_equal_quartile_edges_fail(spark):
    df = _clv(spark, [10.0] * 10 + [20.0])
    with pytest.raises(Exception, match="not unique"):
        clv_cuts(df).collect()


def test_single_class_report_keeps_both_statuses(spark):
    df = _clv(spark, [10.0, 20.0, 30.0], churn=[0, 0, 0])
    rows = {r.status: r for r in R.clv_by_churn(df).collect()}
    assert rows["Not Churned"].n == 3 and rows["Churned"].n == 0
    assert rows["Churned"].mean_clv is None


def test_absent_quartile_kept_with_nulls(spark):
    df = _clv(spark, [10.0, 20.0]).withColumn("CLV_quartile", F.lit("Low"))
    rows = R.churn_by_quartile(df).collect()
    assert [r.CLV_quartile for r in rows] == ["Low", "Medium", "High", "Premium"]
    assert rows[1].total is None


def test_unseen_category_fails(spark):
    from retentio import constants as K
    base = spark.createDataFrame([("Female",), ("Male",)], "gender string")
    model = fit_codes(base, ["gender"])
    assert [r.gender for r in encode(base, model).collect()] == [0, 1]
    with pytest.raises(Exception):
        encode(spark.createDataFrame([("Other",)], "gender string"), model).collect()
    assert K.CATEGORY_DOMAINS["gender"] == ("Female", "Male")


def test_histogram_max_in_last_bin(spark):
    df = _clv(spark, [1.0, 2.0, 3.0, 4.0])
    rows = R.clv_histogram(df, bins=3).collect()
    assert [r.n for r in rows] == [1, 1, 2]


def test_string_columns_from_schema_match_encoded_features(spark, sf_dir):
    from retentio import constants as K
    from retentio.operators.encode import string_columns
    from retentio.workspace import workspace
    assert sorted(string_columns(workspace(spark, sf_dir).prepared)) == sorted(K.STRING_FEATURES)
