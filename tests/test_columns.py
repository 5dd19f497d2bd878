"""Column functions: the F3 profiles by hand, nulls, ties, buckets."""

import pytest
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.functions import columns as C
from retentio.ml.scoring import profiles_frame
from retentio.operators.prepare import engineer, serving_features


def test_profiles_serving_form(spark):
    rows = {r.customer_id: r for r in serving_features(profiles_frame(spark)).collect()}
    hi, lo = rows["HIGH_RISK"], rows["LOW_RISK"]
    assert (hi.tenure_bucket, hi.services_count, hi.monthly_to_total_ratio) == ("0-6m", 2, 1.0)
    assert (hi.flag_internet_no_tech_support, hi.flag_fiber_high_charges, hi.flag_short_tenure_monthly) == (1, 1, 1)
    assert (hi.expected_tenure, hi.CLV) == (12, 1260.0)
    assert (lo.tenure_bucket, lo.services_count, lo.monthly_to_total_ratio) == ("24m+", 8, 1.0)
    assert (lo.flag_internet_no_tech_support, lo.flag_fiber_high_charges, lo.flag_short_tenure_monthly) == (0, 0, 0)
    assert (lo.expected_tenure, lo.CLV) == (24, 2040.0)


def test_profiles_training_form_counts_nine_services(spark):
    df = profiles_frame(spark)
    rows = {r.customer_id: r for r in engineer(df, cut=70.0).collect()}
    assert rows["HIGH_RISK"].services_count == 2
    assert rows["LOW_RISK"].services_count == 9


def test_total_defaults_to_tenure_times_monthly(spark):
    df = profiles_frame(spark).withColumn("TotalCharges", F.lit(None).cast("double"))
    r = {x.customer_id: x for x in serving_features(df).collect()}
    assert r["HIGH_RISK"].TotalCharges == 2 * 105.0
    assert r["LOW_RISK"].TotalCharges == 48 * 85.0


@pytest.mark.parametrize("text,expected", [
    (" ", None), ("", None), ("12.5", 12.5), (" 7 ", 7.0), ("1e3", 1000.0),
    ("NaN", None), ("Infinity", None), ("1d", None), ("abc", None), (None, None),
])
def test_to_number(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(C.to_number("t").alias("v")).first().v
    assert got == expected


def test_impute_total_branches(spark):
    df = spark.createDataFrame([(None, 0, 50.0), (None, 3, 50.0), (80.0, 3, 50.0)], "t double, tenure int, mc double")
    got = [r.v for r in df.select(C.impute_total("t", "tenure", "mc").alias("v")).collect()]
    assert got == [0.0, 50.0, 80.0]


@pytest.mark.parametrize("tenure,label", [(0, "0-6m"), (6, "0-6m"), (7, "6-12m"), (12, "6-12m"),
                                          (13, "12-24m"), (24, "12-24m"), (25, "24m+"), (None, "24m+")])
def test_tenure_bucket(spark, tenure, label):
    got = spark.createDataFrame([(tenure,)], "t int").select(C.tenure_bucket("t").alias("b")).first().b
    assert got == label


def test_flags_treat_null_as_false(spark):
    df = spark.createDataFrame([(None, None, None, None, None)],
                               "InternetService string, TechSupport string, MonthlyCharges double, tenure int, Contract string")
    r = df.select(C.flag_internet_no_support().alias("a"), C.flag_fiber_high_charges(70.0).alias("b"),
                  C.flag_short_tenure_monthly().alias("c")).first()
    assert (r.a, r.b, r.c) == (0, 0, 0)


def test_ratio_guards(spark):
    df = spark.createDataFrame([(10.0, 0, 0.5)], "t double, tenure int, mc double")
    r = df.select(C.charge_ratio("t", "tenure", "mc").alias("train"),
                  C.charge_ratio("t", "tenure", "mc", serving=True).alias("serve")).first()
    assert r.train == 10.0 and r.serve == 10.0


def test_round_half_even_matches_numpy(spark):
    import numpy as np
    xs = [0.125, 0.135, 2.675, 0.545, 1.005, 12.25, -0.125, 0.5, 1.5, 2.5]
    got = [r.v for r in spark.createDataFrame([(x,) for x in xs], "x double")
           .select(C.round_half_even("x", 2).alias("v")).collect()]
    assert got == [float(np.round(x, 2)) for x in xs]


@pytest.mark.parametrize("score,level", [(0.0, "Low"), (0.2999, "Low"), (0.3, "Medium"),
                                         (0.5999, "Medium"), (0.6, "High"), (1.0, "High")])
def test_risk_level(spark, score, level):
    got = spark.createDataFrame([(score,)], "s double").select(C.risk_level("s").alias("r")).first().r
    assert got == level


def test_expected_tenure_unknown_contract_is_twelve(spark):
    df = spark.createDataFrame([("One year",), ("Two year",), ("Month-to-month",), ("Weekly",), (None,)], "Contract string")
    assert [r.e for r in df.select(C.expected_tenure().alias("e")).collect()] == [24, 24, 12, 12, 12]


def test_money_and_percent_text(spark):
    df = spark.createDataFrame([(1234.5, 26.0), (1235.5, 9.95)], "m double, p double")
    got = [(r.a, r.b) for r in df.select(C.money_text("m").alias("a"), C.percent_text("p").alias("b")).collect()]
    assert got == [("$1234", "26.0%"), ("$1236", "10.0%")]
