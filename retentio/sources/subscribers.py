"""Subscriber source over the order tables (the F6 adapter).

Builds the raw subscriber table (fixed schema ``schema.RAW_SUBSCRIBERS``)
from ``customer`` and ``orders``: churn means "no order in the last 365 days
of the data"; tenure is the month span of a customer's orders; service
columns are spread by remainders of the customer key; contract comes from
the order count, internet type from the market segment, the monthly charge
from the account balance. Every 50th customer has tenure 0 and every 97th
a blank total, so both imputation branches of cleaning are exercised.

Plan shape: ``orders`` is read with two columns (pruned at the scan) and
partially aggregated per customer before the shuffle, so a customer with a
third of all orders is combined map-side. The data's last order date is a
global ``max`` over one column (a partial max per task; one row, broadcast).
The customer side joins the aggregate on the key; at scale both sides are
large and AQE picks sort-merge or shuffled hash (skew join enabled).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.schema import RAW_COLUMNS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def _addon(k: Column, net: Column, modulus: int, below: int) -> Column:
    return (
        F.when(net == "No", F.lit("No internet service"))
        .when(k % modulus < below, F.lit("Yes"))
        .otherwise(F.lit("No"))
    )


def subscribers_from_orders(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Raw subscriber rows, one per customer, in the raw fixed schema."""
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.min("o_orderdate").alias("first_dt"),
        F.max("o_orderdate").alias("last_dt"),
    )
    # one row by construction (global aggregate over one pruned column:
    # a partial max per task, then one row per task to a single reducer)
    last_day = orders.agg(F.max("o_orderdate").alias("ref_dt"))

    c = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    base = (
        c.join(per_customer, c.c_custkey == per_customer.o_custkey, "left")
        .crossJoin(F.broadcast(last_day))
        .select(
            F.col("c_custkey").alias("k"),
            F.col("c_nationkey").alias("nk"),
            F.coalesce(F.col("n_orders"), F.lit(0)).alias("n_orders"),
            F.when(F.col("last_dt").isNull() | (F.col("c_custkey") % 50 == 0), F.lit(0))
            .otherwise(
                F.least(
                    F.lit(72),
                    (F.year("last_dt") - F.year("first_dt")) * 12
                    + (F.month("last_dt") - F.month("first_dt")),
                )
            )
            .alias("tenure"),
            (F.lit(18.0) + (F.col("c_acctbal") + F.lit(1000.0)) * F.lit(102.0) / F.lit(11000.0)).alias("mc"),
            F.when(
                F.col("last_dt").isNull()
                | (F.col("last_dt") < F.col("ref_dt") - F.expr("INTERVAL 365 DAYS")),
                F.lit("Yes"),
            )
            .otherwise(F.lit("No"))
            .alias("churn"),
            F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), F.lit("Fiber optic"))
            .when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), F.lit("DSL"))
            .otherwise(F.lit("No"))
            .alias("net"),
        )
    )
    k, net, tenure, mc = F.col("k"), F.col("net"), F.col("tenure"), F.col("mc")
    nk4 = F.col("nk") % 4
    total = (tenure * mc * (F.lit(0.4) + (k % 13) * F.lit(0.1))).cast("string")
    out = base.select(
        k.cast("string").alias("customerID"),
        F.when(k % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.when(k % 6 == 0, F.lit(1)).otherwise(F.lit(0)).alias("SeniorCitizen"),
        _yes_no(k % 3 == 0).alias("Partner"),
        _yes_no(k % 5 < 2).alias("Dependents"),
        tenure.cast("int").alias("tenure"),
        _yes_no(k % 10 != 0).alias("PhoneService"),
        F.when(k % 10 == 0, F.lit("No phone service")).otherwise(_yes_no(k % 7 < 3)).alias("MultipleLines"),
        net.alias("InternetService"),
        _addon(k, net, 11, 4).alias("OnlineSecurity"),
        _addon(k, net, 13, 5).alias("OnlineBackup"),
        _addon(k, net, 17, 7).alias("DeviceProtection"),
        _addon(k, net, 19, 7).alias("TechSupport"),
        _addon(k, net, 23, 11).alias("StreamingTV"),
        _addon(k, net, 29, 14).alias("StreamingMovies"),
        F.when(F.col("n_orders") >= 13, F.lit("Two year"))
        .when(F.col("n_orders") >= 11, F.lit("One year"))
        .otherwise(F.lit("Month-to-month"))
        .alias("Contract"),
        _yes_no(k % 31 < 18).alias("PaperlessBilling"),
        F.when(nk4 == 0, F.lit("Bank transfer (automatic)"))
        .when(nk4 == 1, F.lit("Credit card (automatic)"))
        .when(nk4 == 2, F.lit("Electronic check"))
        .otherwise(F.lit("Mailed check"))
        .alias("PaymentMethod"),
        mc.alias("MonthlyCharges"),
        F.when((tenure == 0) | (k % 97 == 0), F.lit(" ")).otherwise(total).alias("TotalCharges"),
        F.col("churn").alias("Churn"),
    )
    return out.select(*RAW_COLUMNS)


def load_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw subscriber table derived from the order tables in ``sf_dir``."""
    return subscribers_from_orders(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders"))
