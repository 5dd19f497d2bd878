"""Aggregate expressions with results that do not depend on partitioning.

A sum of doubles depends on the order in which partial sums meet, so the
same query can give different last bits on different cluster layouts or
after a retried task. Money and other fractional sums here are taken in
fixed point (DECIMAL with 6 places, exact addition) and turned back into a
double at the end; averages divide that exact sum by the count. Integer
sums stay integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"
SQUARES = "decimal(26,6)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(x: Column | str) -> Column:
    return F.sum(_c(x).cast(MONEY)).cast("double")


def exact_avg(x: Column | str) -> Column:
    return exact_sum(x) / F.count(_c(x))


def _moments(x: Column | str) -> tuple[Column, Column, Column]:
    d = _c(x).cast("double")
    s1 = F.sum(d.cast(MONEY)).cast("double")
    s2 = F.sum((d * d).cast(SQUARES)).cast("double")
    return s1, s2, F.count(_c(x)).cast("double")


def exact_var_samp(x: Column | str) -> Column:
    """Sample variance from fixed-point first and second moments.

    Suited to bounded business values (charges, months, codes), where the
    mean square does not swamp the variance.
    """
    s1, s2, n = _moments(x)
    return F.when(n > 1, (s2 - s1 * s1 / n) / (n - 1))


def exact_var_pop(x: Column | str) -> Column:
    s1, s2, n = _moments(x)
    return F.when(n > 0, (s2 - s1 * s1 / n) / n)


def _sqrt_clamped(v: Column) -> Column:
    return F.sqrt(F.when(v < 0, F.lit(0.0)).otherwise(v))


def exact_std_samp(x: Column | str) -> Column:
    return _sqrt_clamped(exact_var_samp(x))


def exact_std_pop(x: Column | str) -> Column:
    return _sqrt_clamped(exact_var_pop(x))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def rate(flag: Column | str) -> Column:
    """Mean of a 0/1 column (integer sum over count: exact division)."""
    return F.avg(_c(flag).cast("double"))
