"""Linear attributions.

Per-feature statistics are one wide aggregate over the training rows
(fixed-point moments: mean, sample and population std, and the Pearson
correlation with the label). They form a single row that is broadcast into
the per-customer projection, so contributions, their ordering and the top
factors are column expressions on each row: no shuffle, no UDF.

Contribution of feature j for a customer: ``coefficient_j * z_j`` with
``z_j = (x_j - mean_j) / std_j`` (0 when std is 0, as MLlib's scaler does).
Coefficients come either from a fitted logistic model (``ml.explain``) or,
for an exactly checkable stand-in, from the correlation of each scaled
feature with the label (``correlation_coefficients``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.functions import aggregates as G
from retentio.functions import columns as C


def feature_stats(train: DataFrame, features: Sequence[str] = K.FEATURE_COLUMNS, label: str = "Churn") -> DataFrame:
    """Per feature: position, feature, mean, std_samp, std_pop, correlation.

    The feature columns are turned into (position, value) rows with
    ``posexplode`` and aggregated by position: map-side partial sums leave
    one row per feature and task for the shuffle, and the generated code
    stays small however many features there are.
    """
    d = F.col("_x")
    y = F.col("_y")
    long = train.select(
        F.col(label).cast("double").alias("_y"),
        F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("position", "_x"),
    )
    sums = long.groupBy("position").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(d.cast(G.MONEY)).cast("double").alias("sx"),
        F.sum((d * d).cast(G.SQUARES)).cast("double").alias("sxx"),
        F.sum((d * y).cast(G.SQUARES)).cast("double").alias("sxy"),
        F.sum(y.cast(G.MONEY)).cast("double").alias("sy"),
        F.sum((y * y).cast(G.SQUARES)).cast("double").alias("syy"),
    )
    n, sx, sxx, sxy, sy, syy = (F.col(c) for c in ("n", "sx", "sxx", "sxy", "sy", "syy"))
    var_s = (sxx - sx * sx / n) / (n - 1)
    var_p = (sxx - sx * sx / n) / n
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    cov = n * sxy - sx * sy
    names = F.array(*[F.lit(f) for f in features])
    return sums.select(
        "position", names[F.col("position")].alias("feature"), (sx / n).alias("mean"),
        F.sqrt(F.when(var_s < 0, F.lit(0.0)).otherwise(var_s)).alias("std_samp"),
        F.sqrt(F.when(var_p < 0, F.lit(0.0)).otherwise(var_p)).alias("std_pop"),
        F.when(vx * vy > 0, cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0)).alias("correlation"),
    )


def stats_row(stats: DataFrame, coefficient: str = "correlation", std: str = "std_samp") -> DataFrame:
    """One row, ``stats``: array of (position, m, s, c) ordered by position.

    ``stats`` has one row per model feature, so the collected array is as
    long as the feature list.
    """
    item = F.struct(F.col("position"), F.col("mean").alias("m"), F.col(std).alias("s"), F.col(coefficient).alias("c"))
    return stats.agg(F.array_sort(F.collect_list(item)).alias("stats"))


def wide_stats(train: DataFrame, features: Sequence[str] = K.FEATURE_COLUMNS, label: str = "Churn") -> DataFrame:
    """The statistics row of a correlation scorer fitted on ``train``."""
    return stats_row(feature_stats(train, features, label))


def _contribution_array(features: Sequence[str]) -> Column:
    """Per row: array of (position, feature, value, coefficient, contribution).

    One lambda over the zipped arrays (row values and the statistics row),
    so the expression does not grow with the feature count.
    """
    xs = F.array(*[F.col(f).cast("double") for f in features])
    names = F.array(*[F.lit(f) for f in features])
    zipped = F.arrays_zip(names.alias("feature"), xs.alias("x"), F.col("stats").alias("st"))

    def one(e: Column) -> Column:
        st = e["st"]
        z = F.when(st["s"] > 0, (e["x"] - st["m"]) / st["s"]).otherwise(F.lit(0.0))
        return F.struct(
            st["position"].alias("position"), e["feature"].alias("feature"), z.alias("value"),
            st["c"].alias("coefficient"), (st["c"] * z).alias("contribution"),
        )

    return F.transform(zipped, one)


def with_contributions(rows: DataFrame, stats: DataFrame, features: Sequence[str] = K.FEATURE_COLUMNS,
                       key: str = "customer_id") -> DataFrame:
    """``key`` and an array of (position, feature, value, coefficient, contribution)."""
    # the statistics are one row: broadcast by construction
    return rows.crossJoin(F.broadcast(stats)).select(key, _contribution_array(features).alias("contributions"))


def linear_contributions(rows: DataFrame, stats_row: DataFrame, features: Sequence[str] = K.FEATURE_COLUMNS) -> DataFrame:
    """Long form (L14): customer_id, feature, value, coefficient, contribution, abs_contribution."""
    arr = with_contributions(rows, stats_row, features)
    return arr.select("customer_id", F.explode("contributions").alias("c")).select(
        "customer_id", "c.feature", "c.value", "c.coefficient", "c.contribution",
        F.abs("c.contribution").alias("abs_contribution"),
    )


def top_factors_array(contributions: Column, k: int = K.TOP_FACTORS) -> Column:
    """The k largest |contribution| as (feature, weight, direction), per row.

    Sorting is inside each row's array, by the natural order of
    (-weight, position) structs: ties are broken by feature position.
    """
    keyed = F.transform(contributions, lambda c: F.struct(
        (-F.abs(c["contribution"])).alias("down"), c["position"].alias("position"), c["feature"].alias("feature"), c["contribution"].alias("contribution")))
    top = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(top, lambda c: F.struct(
        c["feature"].alias("feature"), F.abs(c["contribution"]).alias("weight"),
        C.direction(c["contribution"]).alias("direction"),
    ))


def top_factors(rows: DataFrame, stats_row: DataFrame, features: Sequence[str] = K.FEATURE_COLUMNS,
                k: int = K.TOP_FACTORS) -> DataFrame:
    """Long form: customer_id, factor_rank (1..k), feature, weight, direction."""
    arr = with_contributions(rows, stats_row, features)
    return arr.select("customer_id", F.posexplode(top_factors_array(F.col("contributions"), k)).alias("pos", "f")).select(
        "customer_id", (F.col("pos") + 1).alias("factor_rank"), "f.feature", "f.weight", "f.direction"
    )


def global_contributions(rows: DataFrame, stats: DataFrame, features: Sequence[str] = K.FEATURE_COLUMNS) -> DataFrame:
    """Mean |contribution| per feature (A26): exploded, then partial sums by feature."""
    arr = with_contributions(rows, stats, features)
    long = arr.select(F.explode("contributions").alias("c"))
    return long.groupBy(F.col("c.feature").alias("feature")).agg(
        G.exact_avg(F.abs(F.col("c.contribution"))).alias("mean_abs_contribution")
    )


def linear_importance(stats: DataFrame, coefficient: str = "correlation", mode: str = "reference") -> DataFrame:
    """Feature importance of a linear model.

    ``mode="reference"``: |coefficient x population std|, the published
    formula (which multiplies by the std although the coefficients are
    already on scaled data). ``mode="standardized"``: |coefficient|.
    Ranked by importance, ties by feature position.
    """
    imp = F.abs(F.col(coefficient) * F.col("std_pop")) if mode == "reference" else F.abs(F.col(coefficient))
    out = stats.select("position", "feature", F.col(coefficient).alias("coefficient"),
                       F.col("std_pop").alias("std_dev"), imp.alias("importance"))
    # 27 rows (one per model feature): a window over them is trivially small
    from pyspark.sql import Window
    w = Window.orderBy(F.col("importance").desc(), F.col("position"))
    return out.withColumn("importance_rank", F.row_number().over(w)).drop("position")
