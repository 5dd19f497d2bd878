"""Preparation: clean, derive features, lifetime value and its quartiles.

Each step is ``DataFrame -> DataFrame`` and lazy. The two data-dependent
constants (the fiber high-charge cut and the CLV quartile cuts) are one-row
DataFrames computed by distributed quantile plans and broadcast into the
row-wise projection (one row: a size bound by construction), so the whole
preparation stays one plan with no driver round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.functions import columns as C
from retentio.plans.quantiles import quantiles

RAW_FEATURES = K.FEATURE_COLUMNS[:19]
ENGINEERED = K.FEATURE_COLUMNS[19:]


def clean(raw: DataFrame) -> DataFrame:
    """Raw rows -> typed rows.

    ``customerID`` is kept as ``customer_id`` (a key, never a feature);
    TotalCharges becomes a double with blanks imputed; Churn becomes 0/1.
    """
    total = C.to_number("TotalCharges")
    return raw.select(
        F.col("customerID").alias("customer_id"),
        *[c for c in RAW_FEATURES if c != "TotalCharges"],
        C.impute_total(total, "tenure", "MonthlyCharges").alias("TotalCharges"),
        C.yes_flag("Churn").alias("Churn"),
    ).select("customer_id", *RAW_FEATURES, "Churn")


def fiber_cut(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row: the 75th percentile of MonthlyCharges."""
    return quantiles(df, "MonthlyCharges", [K.FIBER_HIGH_CHARGE_PERCENTILE], ["fiber_cut"], exact=exact)


_CUT_PROBS = (0.0, *K.QUARTILE_PROBS, 1.0)


def fit_cuts(cleaned: DataFrame, exact: bool = True) -> DataFrame:
    """One row with every data-dependent constant of preparation.

    ``fiber_cut`` (75th percentile of MonthlyCharges) and the CLV edges
    ``clv_min, q1, q2, q3, clv_max``. CLV depends only on MonthlyCharges and
    Contract, so both columns are stacked and ranked in a single quantile
    plan (one pass, two strata). The CLV edges must rise strictly (equal
    edges make equal-count bins undefined; pandas refuses them too); the
    check runs inside the plan with ``raise_error``.
    """
    stacked = cleaned.select(
        F.explode(F.array(
            F.struct(F.lit("mc").alias("_which"), F.col("MonthlyCharges").cast("double").alias("_x")),
            F.struct(F.lit("clv").alias("_which"), C.lifetime_value("MonthlyCharges", "Contract").cast("double").alias("_x")),
        )).alias("_s")
    ).select("_s._which", "_s._x")
    probs = list(_CUT_PROBS) + [K.FIBER_HIGH_CHARGE_PERCENTILE]
    names = ["e0", "e1", "e2", "e3", "e4", "p75"]
    q = quantiles(stacked, "_x", probs, names, strata=["_which"], exact=exact, strata_bound=2)
    one = q.agg(
        F.max(F.when(F.col("_which") == "mc", F.col("p75"))).alias("fiber_cut"),
        *[F.max(F.when(F.col("_which") == "clv", F.col(f"e{i}"))).alias(a)
          for i, a in enumerate(["clv_min", "q1", "q2", "q3", "clv_max"])],
    )
    rising = (F.col("clv_min") < F.col("q1")) & (F.col("q1") < F.col("q2")) & (F.col("q2") < F.col("q3")) & (
        F.col("q3") < F.col("clv_max")
    )
    failed = F.raise_error(F.lit("CLV quartile edges are not unique")).cast("double")
    return one.select("fiber_cut", "clv_min", F.when(rising, F.col("q1")).otherwise(failed).alias("q1"),
                      "q2", "q3", "clv_max")


def engineer(df: DataFrame, cut: DataFrame | float | None = None, serving: bool = False) -> DataFrame:
    """Add the engineered columns.

    ``serving=False`` is the training form: nine service columns, ratio with
    a zero product replaced by 1, fiber cut from ``cut`` (a one-row DataFrame
    with ``fiber_cut``; computed from ``df`` when None). ``serving=True`` is
    the scoring form: eight service columns, ``max(1, product)`` guard and
    a fixed cut of 70 unless ``cut`` is given.
    """
    if serving:
        services = C.services_count(K.SERVICE_COLUMNS_SERVING)
        ratio = C.charge_ratio("TotalCharges", "tenure", "MonthlyCharges", serving=True)
    else:
        services = C.services_count(K.SERVICE_COLUMNS_TRAINING)
        ratio = C.charge_ratio("TotalCharges", "tenure", "MonthlyCharges")

    if cut is None and serving:
        cut = K.FIBER_HIGH_CHARGE_SERVING
    if cut is None:
        cut = fiber_cut(df)
    if isinstance(cut, DataFrame):
        # one-row cut table: broadcast by construction
        base = df.crossJoin(F.broadcast(cut.select("fiber_cut")))
        fiber = C.flag_fiber_high_charges(F.col("fiber_cut"))
    else:
        base = df
        fiber = C.flag_fiber_high_charges(float(cut))

    out = base.select(
        *df.columns,
        C.tenure_bucket("tenure").alias("tenure_bucket"),
        services.alias("services_count"),
        ratio.alias("monthly_to_total_ratio"),
        C.flag_internet_no_support().alias("flag_internet_no_tech_support"),
        fiber.alias("flag_fiber_high_charges"),
        C.flag_short_tenure_monthly().alias("flag_short_tenure_monthly"),
        C.expected_tenure("Contract").alias("expected_tenure"),
        C.lifetime_value("MonthlyCharges", "Contract").alias("CLV"),
    )
    return out


def clv_cuts(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row of CLV edges (``clv_min, q1, q2, q3, clv_max``) of ``df``."""
    return fit_cuts(df, exact=exact).drop("fiber_cut")


def add_quartiles(df: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Add ``CLV_quartile`` from cuts (computed over ``df`` when None)."""
    cuts = cuts if cuts is not None else clv_cuts(df)
    # one-row cut table: broadcast by construction
    joined = df.crossJoin(F.broadcast(cuts.select("q1", "q2", "q3")))
    return joined.select(
        *df.columns, C.quartile_label("CLV", F.col("q1"), F.col("q2"), F.col("q3")).alias("CLV_quartile")
    )


def prepare(raw: DataFrame, exact: bool = True, cuts: DataFrame | None = None) -> DataFrame:
    """Raw subscriber rows -> cleaned, engineered, CLV and quartile (F2, unencoded).

    ``cuts`` (from ``fit_cuts``) can be passed to apply constants fitted
    elsewhere (e.g. on the training split only).
    """
    return prepare_cleaned(clean(raw), exact=exact, cuts=cuts)


def prepare_cleaned(cleaned: DataFrame, exact: bool = True, cuts: DataFrame | None = None) -> DataFrame:
    """Cleaned rows -> engineered, CLV and quartile."""
    cuts = cuts if cuts is not None else fit_cuts(cleaned, exact=exact)
    # one-row table of constants: broadcast by construction
    cuts = F.broadcast(cuts)
    featured = engineer(cleaned, cuts.select("fiber_cut"))
    return add_quartiles(featured, cuts)


def serving_features(requests: DataFrame, cut: float | DataFrame | None = None) -> DataFrame:
    """Scoring requests (no label) -> model features in the serving form.

    TotalCharges defaults to tenure x monthly (D14); services count eight
    columns; ratio uses ``max(1, product)``; fiber cut 70 unless given.
    """
    total = C.total_or_tenure_times_monthly("TotalCharges", "tenure", "MonthlyCharges")
    base = requests.withColumn("TotalCharges", total)
    return engineer(base, cut=cut, serving=True)
