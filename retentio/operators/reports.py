"""Lifetime-value reports.

Reports read the prepared rows (by default train and test, validation left
out). Label-ordered outputs use a four-row label table as the preserved
side of a left join (J1), so an absent quartile still appears, with nulls.
Medians come from the distributed exact quantile plan, sums are fixed-point
(``functions.aggregates``), rounding is half-to-even on the scaled value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.functions import aggregates as G
from retentio.functions import columns as C
from retentio.plans.quantiles import quantiles

R2 = C.round_half_even


def quartile_order(spark: SparkSession) -> DataFrame:
    """The four quartile labels with their rank (lowest first)."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(K.QUARTILE_LABELS)], "CLV_quartile string, q_rank int")


def _in_label_order(spark: SparkSession, result: DataFrame) -> DataFrame:
    # four labels (fixed) preserved; the result has at most five groups
    return quartile_order(spark).join(result, "CLV_quartile", "left").orderBy("q_rank").drop("q_rank")


def _collapsed_clv(rows: DataFrame, strata: list[str]) -> DataFrame:
    """(strata, CLV, n): the one pass over rows; checkpointed, read by stats and median."""
    from retentio.plans.lineage import checkpoint
    return checkpoint(rows.where(F.col("CLV").isNotNull()).groupBy(*strata, "CLV").agg(F.count(F.lit(1)).alias("n")))


def _weighted_stats(values: DataFrame, strata: list[str]) -> DataFrame:
    """Exact count, sum, mean, sample std and min/max from (value, n) rows.

    Fixed-point sums of value x n equal the row-wise fixed-point sums.
    """
    d = F.col("CLV").cast("double")
    n = F.col("n")
    s1 = F.sum(d.cast(G.MONEY) * n).cast("double")
    s2 = F.sum((d * d).cast(G.SQUARES) * n).cast("double")
    cnt = F.sum(n).cast("long")
    out = values.groupBy(*strata).agg(
        F.min("CLV").alias("min_clv"), F.max("CLV").alias("max_clv"),
        s1.alias("_s1"), s2.alias("_s2"), cnt.alias("n"),
    )
    c = F.col("n").cast("double")
    var = F.when(c > 1, (F.col("_s2") - F.col("_s1") * F.col("_s1") / c) / (c - 1))
    return out.select(
        *strata, "min_clv", "max_clv", "n", F.col("_s1").alias("total_clv"),
        (F.col("_s1") / F.col("n")).alias("mean_clv"),
        F.sqrt(F.when(var < 0, F.lit(0.0)).otherwise(var)).alias("std_clv"),
    )


def clv_summary(rows: DataFrame) -> DataFrame:
    """CLV min, max, mean, median and total (A7), from one pass over the rows."""
    values = _collapsed_clv(rows, [])
    stats = _weighted_stats(values, []).select("min_clv", "max_clv", "mean_clv", "total_clv")
    med = quantiles(values, "CLV", [0.5], ["median_clv"], weight="n")
    return stats.crossJoin(F.broadcast(med))  # both one row


def clv_by_churn(rows: DataFrame) -> DataFrame:
    """Mean, median, sample std and count of CLV by churn status.

    Values rounded to 2 places. Both statuses always appear; an absent
    class has nulls and a count of 0. One pass over the rows.
    """
    spark = rows.sparkSession
    values = _collapsed_clv(rows, ["Churn"])
    stats = _weighted_stats(values, ["Churn"]).select("Churn", "mean_clv", "std_clv", "n")
    med = quantiles(values, "CLV", [0.5], ["median_clv"], strata=["Churn"], strata_bound=2, weight="n")
    status = spark.createDataFrame([(0, "Not Churned"), (1, "Churned")], "Churn int, status string")
    out = status.join(stats, "Churn", "left").join(med, "Churn", "left")
    return out.orderBy("Churn").select(
        "status", R2("mean_clv").alias("mean_clv"), R2("median_clv").alias("median_clv"),
        R2("std_clv").alias("std_clv"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
    )


def _quartile_groups(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("CLV_quartile").isNotNull()).groupBy("CLV_quartile")


def churn_by_quartile(rows: DataFrame) -> DataFrame:
    """Churn rate (percent), churned, total, mean/min/max CLV per quartile.

    The rate is rounded to 2 places before x100 and then to 1 place, as in
    the published table (so its second decimal is always 0).
    """
    agg = _quartile_groups(rows).agg(
        G.rate("Churn").alias("_rate"), F.sum("Churn").cast("long").alias("churned"),
        F.count(F.lit(1)).alias("total"), G.exact_avg("CLV").alias("_avg"),
        F.min("CLV").alias("_min"), F.max("CLV").alias("_max"),
    )
    shaped = agg.select(
        "CLV_quartile", R2(R2("_rate", 2) * 100.0, 1).alias("churn_rate"), "churned", "total",
        R2("_avg").alias("avg_clv"), R2("_min").alias("min_clv"), R2("_max").alias("max_clv"),
    )
    return _in_label_order(rows.sparkSession, shaped)


def revenue_at_risk(rows: DataFrame) -> DataFrame:
    """Six revenue numbers from one pass with conditional aggregates."""
    churned = F.col("Churn") == 1
    kept = F.col("Churn") == 0
    out = rows.agg(
        G.exact_sum("CLV").alias("total_clv"),
        G.exact_sum(F.when(churned, F.col("CLV"))).alias("churned_clv"),
        G.exact_sum(F.when(kept, F.col("CLV"))).alias("retained_clv"),
        G.exact_avg(F.when(churned, F.col("CLV"))).alias("avg_churned_clv"),
        G.exact_avg(F.when(kept, F.col("CLV"))).alias("avg_retained_clv"),
    )
    return out.select(
        "total_clv", "churned_clv", "retained_clv",
        (F.col("churned_clv") / F.col("total_clv") * 100.0).alias("revenue_at_risk_pct"),
        "avg_churned_clv", "avg_retained_clv",
    )


def quartile_stats(rows: DataFrame) -> DataFrame:
    """Dashboard table per quartile (A15, D17, D18): '$n', 'r%' and count."""
    agg = _quartile_groups(rows).agg(
        G.exact_avg("CLV").alias("_avg"), G.rate("Churn").alias("_rate"), F.count(F.lit(1)).alias("n")
    )
    return agg.select(
        "CLV_quartile",
        C.money_text(R2("_avg", 2)).alias("avg_clv"),
        C.percent_text(R2("_rate", 2) * 100.0).alias("churn_rate"),
        "n",
    ).orderBy("CLV_quartile")


def churn_rate_by_quartile(rows: DataFrame) -> DataFrame:
    """Unrounded churn rate in percent per quartile, label order."""
    agg = _quartile_groups(rows).agg((G.rate("Churn") * 100.0).alias("churn_rate_pct"))
    return _in_label_order(rows.sparkSession, agg)


def quartile_extremes(rows: DataFrame) -> DataFrame:
    """Quartile with the highest and the lowest churn rate.

    Ties go to the earlier label in quartile order.
    """
    spark = rows.sparkSession
    rates = _quartile_groups(rows).agg((G.rate("Churn") * 100.0).alias("rate")).join(
        F.broadcast(quartile_order(spark)), "CLV_quartile"  # four fixed labels
    )
    return rates.agg(
        F.max_by("CLV_quartile", F.struct(F.col("rate"), -F.col("q_rank"))).alias("worst_quartile"),
        F.max("rate").alias("worst_rate_pct"),
        F.min_by("CLV_quartile", F.struct(F.col("rate"), F.col("q_rank"))).alias("best_quartile"),
        F.min("rate").alias("best_rate_pct"),
    )


def clv_histogram(rows: DataFrame, bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram of CLV over [min, max] (A18); all bins listed.

    Bin of v: ``least(bins, 1 + floor((v - lo) * bins / (hi - lo)))`` so the
    maximum falls in the last bin.
    """
    spark = rows.sparkSession
    rng = rows.agg(F.min("CLV").alias("lo"), F.max("CLV").alias("hi"))  # one row
    width = F.col("hi") - F.col("lo")
    binned = rows.where(F.col("CLV").isNotNull()).crossJoin(F.broadcast(rng)).select(
        F.when(width == 0, F.lit(1)).otherwise(
            F.least(F.lit(bins), (F.lit(1) + F.floor((F.col("CLV") - F.col("lo")) * F.lit(float(bins)) / width)).cast("int"))
        ).alias("bin")
    )
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(rng))
    edges = edges.select(
        "bin",
        (F.col("lo") + width * (F.col("bin") - 1).cast("double") / F.lit(float(bins))).alias("lo"),
        (F.col("lo") + width * F.col("bin").cast("double") / F.lit(float(bins))).alias("hi"),
    )
    # the bins table has ``bins`` rows (a parameter)
    return F.broadcast(edges).join(counts, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    ).orderBy("bin")


def business_insights(rows: DataFrame) -> DataFrame:
    """Three insight sentences (B1): worst quartile, best quartile, revenue at risk."""
    ext = quartile_extremes(rows)
    risk = revenue_at_risk(rows)
    both = ext.crossJoin(F.broadcast(risk))  # one row each
    # numbers are rounded half-to-even before formatting, so the text does
    # not depend on the formatter's own tie rule
    return both.select(F.explode(F.array(
        F.struct(F.lit(1).alias("insight"), F.format_string(
            K.INSIGHT_WORST, F.col("worst_quartile"), R2("worst_rate_pct", 1)).alias("text")),
        F.struct(F.lit(2).alias("insight"), F.format_string(
            K.INSIGHT_BEST, F.col("best_quartile"), R2("best_rate_pct", 1)).alias("text")),
        F.struct(F.lit(3).alias("insight"), F.format_string(
            K.INSIGHT_RISK, R2("revenue_at_risk_pct", 1), F.format_number(F.rint("churned_clv"), 0)).alias("text")),
    )).alias("r")).select("r.*")


def retention_priority(prepared: DataFrame) -> DataFrame:
    """Retention priority per customer (B2) with a count of risk signals.

    High + month-to-month -> Retain; Medium + month-to-month -> Monitor;
    Premium + a longer contract -> Nurture; else Other. Signals: fiber,
    no tech support, electronic check, tenure under 12, senior.
    """
    q, contract = F.col("CLV_quartile"), F.col("Contract")
    monthly = contract == K.MONTHLY_CONTRACT
    priority = (
        F.when((q == "High") & monthly, F.lit(K.PRIORITY_RETAIN))
        .when((q == "Medium") & monthly, F.lit(K.PRIORITY_MONITOR))
        .when((q == "Premium") & contract.isin(*K.LONG_CONTRACTS), F.lit(K.PRIORITY_NURTURE))
        .otherwise(F.lit(K.PRIORITY_OTHER))
    )
    signals = (
        C.flag(F.col("InternetService") == "Fiber optic") + C.flag(F.col("TechSupport") == "No")
        + C.flag(F.col("PaymentMethod") == "Electronic check") + C.flag(F.col("tenure") < 12)
        + C.flag(F.col("SeniorCitizen") == 1)
    )
    return prepared.select("customer_id", "CLV_quartile", "Contract", "CLV", "Churn",
                           priority.alias("priority"), signals.alias("signals"))


def priority_summary(prepared: DataFrame) -> DataFrame:
    """Customers, churned and CLV per retention priority."""
    return retention_priority(prepared).groupBy("priority").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("Churn").cast("long").alias("churned"),
        G.exact_sum("CLV").alias("total_clv"), G.rate("Churn").alias("churn_rate"),
    )


def high_quartile_savings(rows: DataFrame, cut: float = K.HIGH_QUARTILE_CHURN_CUT) -> DataFrame:
    """CLV kept if churn in the High quartile fell by ``cut``."""
    hit = (F.col("CLV_quartile") == "High") & (F.col("Churn") == 1)
    return rows.agg(G.exact_sum(F.when(hit, F.col("CLV"))).alias("high_churned_clv")).select(
        "high_churned_clv", (F.col("high_churned_clv") * F.lit(cut)).alias("savings")
    )
