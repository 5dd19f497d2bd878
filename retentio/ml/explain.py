"""Explanations from trained models.

* logistic: coefficients and the scaler's mean/std become the one-row
  statistics table of ``operators.attribution``, so per-customer
  contributions and top factors are column expressions (no UDF).
* trees: per-row TreeSHAP (``ml.treeshap``) or, as the fallback when no
  attribution is wanted, the model's global importances with the
  direction word 'affects' (L18).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.functions import columns as C
from retentio.ml.models import TrainedModels, linear_parameters, tree_importance
from retentio.ml.treeshap import attribution_means, attributions, contribution_structs
from retentio.operators.attribution import top_factors_array

AFFECTS = "affects"  # direction word of a global importance


def logistic_stats_row(spark: SparkSession, models: TrainedModels) -> DataFrame:
    """The statistics row of ``operators.attribution`` from the fitted scaler
    and coefficients (27 entries, from the model, not from the data)."""
    items = [(i, mean, std, coef) for i, (_, mean, std, coef) in enumerate(linear_parameters(models))]
    return spark.createDataFrame([(items,)], "stats array<struct<position:int, m:double, s:double, c:double>>")


def logistic_importance(spark: SparkSession, models: TrainedModels, mode: str = "reference") -> DataFrame:
    """feature, coefficient, std_dev, importance."""
    rows = [(i, f, coef, std) for i, (f, _, std, coef) in enumerate(linear_parameters(models))]
    df = spark.createDataFrame(rows, "position int, feature string, coefficient double, std_dev double")
    imp = F.abs(F.col("coefficient") * F.col("std_dev")) if mode == "reference" else F.abs(F.col("coefficient"))
    return df.select("feature", "coefficient", "std_dev", imp.alias("importance")).orderBy(
        F.col("importance").desc(), "feature")


def tree_importance_frame(spark: SparkSession, models: TrainedModels) -> DataFrame:
    """model, feature, importance for each tree model."""
    rows = [(m, f, v) for m in ("random_forest", "boosted") if m in models.models for f, v in tree_importance(models, m)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def importance_factors(spark: SparkSession, models: TrainedModels, name: str, k: int = K.TOP_FACTORS) -> DataFrame:
    """Fallback factors (L18): top-k global importances, direction 'affects'."""
    return spark.createDataFrame(
        [(i + 1, f, v, AFFECTS) for i, (f, v) in enumerate(_top_importances(models, name, k))],
        "factor_rank int, feature string, weight double, direction string",
    )


def _top_importances(models: TrainedModels, name: str, k: int) -> list[tuple[str, float]]:
    if name == "logistic":
        pairs = [(f, abs(coef)) for f, _, _, coef in linear_parameters(models)]
    else:
        pairs = tree_importance(models, name)
    return sorted(pairs, key=lambda t: (-t[1], K.FEATURE_COLUMNS.index(t[0])))[:k]


def fallback_array(models: TrainedModels, name: str, k: int = K.TOP_FACTORS) -> F.Column:
    """The fallback factors as a column: a constant of k entries."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("weight"), F.lit(AFFECTS).alias("direction"))
                     for f, v in _top_importances(models, name, k)])


def _kind(name: str) -> str:
    return "forest" if name == "random_forest" else "boosted"


def tree_explanations(scored_features: DataFrame, models: TrainedModels, name: str = "boosted",
                      k: int = K.TOP_FACTORS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per customer: base, output, top-k factors from TreeSHAP (L15, L17), beside the ``carry`` columns.

    Rows that cannot be explained have null factors.
    """
    att = attributions(scored_features, models.models[name], _kind(name), carry=carry, nodes=models.nodes.get(name))
    factors = top_factors_array(contribution_structs(F.col("contributions")), k)
    return att.select("customer_id", *carry, "base_value", "output", factors.alias("top_factors"))


def logistic_explanations(scored_features: DataFrame, stats: DataFrame, k: int = K.TOP_FACTORS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The same for the logistic model, from the feature vector (column expressions only)."""
    from pyspark.ml.functions import vector_to_array

    rows = scored_features.select("customer_id", *carry, vector_to_array("features").alias("_x"))
    # the statistics are one row: broadcast by construction
    both = rows.crossJoin(F.broadcast(stats))
    contributions = F.zip_with("_x", "stats", lambda x, st: F.when(st["s"] > 0, st["c"] * ((x - st["m"]) / st["s"])).otherwise(F.lit(0.0)))
    return both.select("customer_id", *carry, top_factors_array(contribution_structs(contributions), k).alias("top_factors"))


def global_tree_attribution(sample_features: DataFrame, models: TrainedModels, name: str) -> DataFrame:
    """Mean |TreeSHAP| per feature over the given rows (L16, A26 for trees)."""
    means = attribution_means(sample_features, models.models[name], _kind(name), nodes=models.nodes.get(name))
    names = F.array(*[F.lit(f) for f in K.FEATURE_COLUMNS])
    return means.select(names[F.col("position")].alias("feature"), "mean_abs_attribution")


def explanation(explained: DataFrame, probability: str = "churn_probability", fallback: F.Column | None = None) -> DataFrame:
    """Score, its risk level, top factors and CLV per customer (L17); null factors become the ``fallback``.

    The scores come along with the factors: a projection, no join.
    """
    factors = F.col("top_factors") if fallback is None else F.coalesce("top_factors", fallback)
    return explained.select(
        "customer_id", F.col(probability).alias("churn_probability"), C.risk_level(probability).alias("risk_level"),
        factors.alias("top_factors"), "clv",
    )
