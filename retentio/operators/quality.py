"""Profile and quality aggregates.

All of them are single-pass aggregates with map-side partial aggregation;
results are a handful of rows. Per-column profiles aggregate every column
in one ``agg`` and then turn the one wide row into rows with ``explode``.

The profiles of whole stages are two parts: ``*_sums`` (aggregate columns) and
``*_rows`` (their one wide row as a table). ``df.agg`` takes the first over any table; the workspace
takes them as observations while it writes a stage, so its queries need no scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.functions import aggregates as G
from retentio.functions import columns as C


def _rows(pairs: Sequence[tuple[str, Column]], name: str, value: str) -> Column:
    """Array of (name, value) structs; explode it to turn columns into rows."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in pairs]))


def missing_sums(columns: Sequence[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_profiled"), *[G.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]]


def missing_rows(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = wide.select("n_profiled", _rows([(c, F.col(f"missing_{c}")) for c in columns], "column_name", "missing").alias("r"))
    return long.select(
        F.col("r.column_name").alias("column_name"),
        F.col("r.missing").alias("missing"),
        (F.col("r.missing").cast("double") * 100.0 / F.col("n_profiled")).alias("missing_pct"),
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and percent per column (A1), one row per column."""
    return missing_rows(df.agg(*missing_sums(df.columns)), df.columns)


def conversion_sums() -> list[Column]:
    """Of raw rows: totals that are not numbers, and what they become."""
    number, new = C.to_number("TotalCharges").isNull(), F.coalesce(F.col("tenure") == 0, F.lit(False))
    return [
        G.count_if(F.col("TotalCharges").isNotNull() & number).alias("totals_not_numeric"),
        G.count_if(number & new).alias("totals_new_customer"), G.count_if(number & ~new).alias("totals_one_month"),
    ]


def conversion_rows(wide: DataFrame) -> DataFrame:
    names = ["totals_not_numeric", "totals_new_customer", "totals_one_month"]
    return wide.select(_rows([(n, F.col(n)) for n in names], "conversion", "customers").alias("r")).select("r.*")


def class_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"), F.sum("Churn").cast("long").alias("churned"), G.rate("Churn").alias("churn_rate")]


def class_rows(wide: DataFrame) -> DataFrame:
    return wide.select(
        "n_rows", "churned", "churn_rate",
        ((F.col("churn_rate") < K.IMBALANCE_LOW) | (F.col("churn_rate") > K.IMBALANCE_HIGH)).alias("imbalanced"),
    )


def class_balance(cleaned: DataFrame) -> DataFrame:
    """Rows, churned, churn rate and the imbalance warning."""
    return class_rows(cleaned.agg(*class_sums()))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of a category (A3)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def derived_ranges(prepared: DataFrame) -> DataFrame:
    """Min, max and mean of services_count and the charge ratio (A4)."""
    feats = ["services_count", "monthly_to_total_ratio"]
    wide = prepared.agg(*[
        e for i, f in enumerate(feats) for e in (
            F.min(f).cast("double").alias(f"mn{i}"), F.max(f).cast("double").alias(f"mx{i}"), G.exact_avg(f).alias(f"av{i}"))
    ])
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"mn{i}").alias("min_value"), F.col(f"mx{i}").alias("max_value"),
                 F.col(f"av{i}").alias("mean_value"))
        for i, f in enumerate(feats)
    ]))
    return wide.select(rows.alias("r")).select("r.*")


def anomaly_sums() -> list[Column]:
    return [G.count_if(C.ratio_is_anomalous("monthly_to_total_ratio")).alias("anomalies")]


def ratio_anomalies(prepared: DataFrame) -> DataFrame:
    """Count of customers with ratio above 1.5 or below 0.5 (A5, P10)."""
    return prepared.agg(*anomaly_sums())


FLAGS = ("flag_internet_no_tech_support", "flag_fiber_high_charges", "flag_short_tenure_monthly")


def flag_sums() -> list[Column]:
    return [F.sum(f).cast("long").alias(f) for f in FLAGS]


def flag_rows(wide: DataFrame) -> DataFrame:
    return wide.select(_rows([(f, F.col(f)) for f in FLAGS], "flag", "customers").alias("r")).select("r.*")


def flag_totals(prepared: DataFrame) -> DataFrame:
    """Customers per risk flag."""
    return flag_rows(prepared.agg(*flag_sums()))


def quartile_sizes(prepared: DataFrame) -> DataFrame:
    """Customers and mean CLV per quartile."""
    return prepared.where(F.col("CLV_quartile").isNotNull()).groupBy("CLV_quartile").agg(
        F.count(F.lit(1)).alias("n"), G.exact_avg("CLV").alias("mean_clv")
    )


def quartile_churn(prepared: DataFrame) -> DataFrame:
    """Churn rate and customers per quartile."""
    return prepared.where(F.col("CLV_quartile").isNotNull()).groupBy("CLV_quartile").agg(
        G.rate("Churn").alias("churn_rate"), F.count(F.lit(1)).alias("n")
    )


def split_balance(prepared: DataFrame) -> DataFrame:
    """Split sizes, churn rate per split, gap to the overall rate.

    One pass: the overall rate is summed from the per-split rows (three
    rows, so the window over them is small).
    """
    from pyspark.sql import Window
    per = prepared.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Churn").cast("long").alias("churned"), G.rate("Churn").alias("churn_rate")
    )
    every = Window.partitionBy()  # one row per split
    gaps = per.withColumn("overall_rate", F.sum("churned").over(every) / F.sum("n").over(every)).withColumn(
        "gap_points", F.abs(F.col("churn_rate") - F.col("overall_rate")) * 100.0
    )
    return gaps.withColumn("max_gap_points", F.max("gap_points").over(every)).withColumn(
        "stratified_ok", F.col("max_gap_points") < K.SPLIT_DRIFT_POINTS
    )


def class_weights(train: DataFrame, label: str = "Churn") -> DataFrame:
    """Class counts and the two weightings.

    ``balanced_weight`` = n / (2 n_class); ``boost_weight`` = negatives /
    positives for the positive class and 1 for the negative class. One pass;
    totals come from the per-class rows (a binary label: two rows).
    """
    from pyspark.sql import Window
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per class
    total = F.sum("n").over(every)
    pos = F.max(F.when(F.col(label) == 1, F.col("n"))).over(every)
    neg = F.max(F.when(F.col(label) == 0, F.col("n"))).over(every)
    return counts.select(
        label, "n",
        (total.cast("double") / (F.lit(2.0) * F.col("n"))).alias("balanced_weight"),
        F.when(F.col(label) == 1, neg.cast("double") / pos).otherwise(F.lit(1.0)).alias("boost_weight"),
    )


def balance_sums() -> list[Column]:
    return [G.rate("Churn").alias("overall_rate"), G.rate(F.when(F.col("split") == "train", F.col("Churn"))).alias("train_rate")]


def balance_rows(wide: DataFrame) -> DataFrame:
    overall, train = F.col("overall_rate"), F.col("train_rate")
    return wide.select(F.explode(F.array(
        F.struct(F.lit("churn_rate_in_band").alias("check_name"), overall.alias("value"),
                 ((overall >= K.IMBALANCE_LOW) & (overall <= K.IMBALANCE_HIGH)).alias("passed")),
        F.struct(F.lit("train_rate_needs_no_weighting").alias("check_name"), train.alias("value"),
                 (train >= K.TRAIN_WEIGHTING_BELOW).alias("passed")),
    )).alias("r")).select("r.*")


def balance_checks(prepared: DataFrame) -> DataFrame:
    """Warnings as a table (C1): overall rate band, train rate for weighting (one pass)."""
    return balance_rows(prepared.agg(*balance_sums()))
