"""Column expressions for cleaning and derived features.

Every function returns a ``Column`` built from ``pyspark.sql.functions``, so
all of it stays inside whole-stage codegen; there are no Python UDFs. Flags
use ``when(...).otherwise(0)`` so a null input gives 0, as a missing value
compared in pandas gives False.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from retentio import constants as K

# A plain decimal or scientific number; anything else (blanks, 'NaN',
# 'Infinity', '1d') is not a number here.
_NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Text to double; text that is not a number gives null."""
    c = _c(c).cast("string")
    return F.when(c.rlike(_NUMERIC), F.trim(c).try_cast("double"))


def impute_total(total: Column | str, tenure: Column | str, monthly: Column | str) -> Column:
    """Missing total: 0 for a new customer (tenure 0), else one month."""
    return F.coalesce(
        _c(total),
        F.when(_c(tenure) == 0, F.lit(0.0)).otherwise(_c(monthly).cast("double")),
    )


def total_or_tenure_times_monthly(total: Column | str, tenure: Column | str, monthly: Column | str) -> Column:
    """Serving default: a missing total is tenure x monthly."""
    return F.coalesce(_c(total).cast("double"), _c(tenure) * _c(monthly))


def yes_flag(c: Column | str) -> Column:
    """'Yes' -> 1, anything else (null included) -> 0."""
    return F.when(_c(c) == "Yes", F.lit(1)).otherwise(F.lit(0))


def tenure_bucket(tenure: Column | str) -> Column:
    """Months to bucket label; a null tenure falls to the last bucket."""
    t = _c(tenure)
    expr = None
    for upper, label in K.TENURE_BUCKETS:
        expr = F.when(t <= upper, F.lit(label)) if expr is None else expr.when(t <= upper, F.lit(label))
    return expr.otherwise(F.lit(K.TENURE_BUCKET_LAST))


def services_count(columns: Sequence[str] = K.SERVICE_COLUMNS_TRAINING) -> Column:
    """Number of subscribed services (D2 training form, D3 serving form)."""
    terms = []
    for name in columns:
        if name == "InternetService":
            terms.append(F.when(F.col(name).isin(*K.INTERNET_TYPES), F.lit(1)).otherwise(F.lit(0)))
        else:
            terms.append(yes_flag(name))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def charge_ratio(total: Column | str, tenure: Column | str, monthly: Column | str, serving: bool = False) -> Column:
    """Total over tenure x monthly (D4 training, D5 serving guard)."""
    expected = _c(tenure) * _c(monthly)
    if serving:
        return _c(total) / F.greatest(F.lit(1.0), expected)
    return _c(total) / F.when(expected == 0, F.lit(1.0)).otherwise(expected)


def ratio_is_anomalous(ratio: Column | str) -> Column:
    r = _c(ratio)
    return (r > K.RATIO_ANOMALY_HIGH) | (r < K.RATIO_ANOMALY_LOW)


def flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def flag_internet_no_support() -> Column:
    return flag(F.col("InternetService").isin(*K.INTERNET_TYPES) & (F.col("TechSupport") == "No"))


def flag_fiber_high_charges(cut: Column | float) -> Column:
    """Fiber and monthly charge above ``cut`` (a fitted percentile or 70)."""
    cut = cut if isinstance(cut, Column) else F.lit(float(cut))
    return flag((F.col("InternetService") == "Fiber optic") & (F.col("MonthlyCharges") > cut))


def flag_short_tenure_monthly() -> Column:
    return flag((F.col("tenure") <= K.SHORT_TENURE_MONTHS) & (F.col("Contract") == K.MONTHLY_CONTRACT))


def expected_tenure(contract: Column | str = "Contract") -> Column:
    """24 months for one- and two-year contracts, else 12."""
    return F.when(_c(contract).isin(*K.LONG_CONTRACTS), F.lit(K.EXPECTED_TENURE_LONG)).otherwise(
        F.lit(K.EXPECTED_TENURE_SHORT)
    )


def lifetime_value(monthly: Column | str = "MonthlyCharges", contract: Column | str = "Contract") -> Column:
    """CLV = monthly charge x expected tenure."""
    return _c(monthly) * expected_tenure(contract)


def clv_or_fallback(clv: Column | str, monthly: Column | str) -> Column:
    """CLV when known, else twelve months of the monthly charge."""
    return F.coalesce(_c(clv), _c(monthly) * F.lit(float(K.CLV_FALLBACK_MONTHS)))


def quartile_label(clv: Column | str, q1: Column, q2: Column, q3: Column) -> Column:
    """Right-closed equal-count bins; the lowest value is in 'Low' (D11)."""
    v = _c(clv)
    low, medium, high, premium = K.QUARTILE_LABELS
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(v <= q1, F.lit(low))
        .when(v <= q2, F.lit(medium))
        .when(v <= q3, F.lit(high))
        .otherwise(F.lit(premium))
    )


def risk_level(score: Column | str) -> Column:
    """Score to Low / Medium / High."""
    s = _c(score)
    low, medium, high = K.RISK_LABELS
    return F.when(s < K.RISK_LOW_BELOW, F.lit(low)).when(s < K.RISK_MEDIUM_BELOW, F.lit(medium)).otherwise(F.lit(high))


def round_half_even(x: Column | str, digits: int = 2) -> Column:
    """Round to ``digits`` places, ties to even on the scaled value.

    ``rint(x * 10^d) / 10^d`` is what numpy's ``round`` computes; Spark's
    ``bround`` rounds the decimal text instead and differs on some ties.
    """
    scale = float(10 ** digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def money_text(x: Column | str) -> Column:
    """'$' and the amount rounded to a whole number."""
    return F.concat(F.lit("$"), F.rint(_c(x)).cast("long").cast("string"))


def percent_text(x: Column | str) -> Column:
    """Percent with one decimal and a '%' sign."""
    return F.concat(round_half_even(x, 1).cast("string"), F.lit("%"))


def direction(weight: Column | str) -> Column:
    """'increases' for a positive contribution, else 'decreases' (D19)."""
    return F.when(_c(weight) > 0, F.lit("increases")).otherwise(F.lit("decreases"))
