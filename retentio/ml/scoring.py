"""Scoring customers in batch or as a stream.

``score`` takes rows that already carry the 27 model features, runs one combined ``PipelineModel`` (feature stages
plus every model; a single projection, no shuffle) and adds per-model
probabilities, their plain mean, the risk level and the lifetime value.
A batch of one row and a streaming micro-batch go through the same code.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.functions import columns as C
from retentio.ml.models import cols, probability
from retentio.operators.prepare import engineer, serving_features
from retentio.schema import SCORING_REQUEST


def score(rows: DataFrame, model: PipelineModel, keep: tuple[str, ...] = ("customer_id",), features: bool = False) -> DataFrame:
    """Scores of ``rows``, beside the ``keep`` columns and, if asked for, the assembled feature vector."""
    more = ["features"] if features else []
    present = [m for m in K.MODEL_NAMES if cols(m)["prob"] in _output_cols(model)]
    out = model.transform(rows)
    probs = [probability(m).alias(f"p_{m}") for m in present]
    scored = out.select(*[c for c in keep if c in rows.columns], *more, *probs,
                        "expected_tenure", "CLV", "MonthlyCharges")
    mean = sum((F.col(f"p_{m}") for m in present[1:]), F.col(f"p_{present[0]}")) / F.lit(float(len(present)))
    return scored.select(
        *[c for c in keep if c in rows.columns], *more, *[f"p_{m}" for m in present],
        mean.alias("churn_probability"),
        C.risk_level(mean).alias("risk_level"),
        C.clv_or_fallback("CLV", "MonthlyCharges").alias("clv"),
        F.col("expected_tenure"),
    )


def _output_cols(model: PipelineModel) -> set[str]:
    names = set()
    for st in model.stages:
        for p in ("probabilityCol",):
            if st.hasParam(p):
                names.add(st.getOrDefault(p))
    return names


def profiles_frame(spark: SparkSession) -> DataFrame:
    """The two reference profiles as scoring requests."""
    rows = []
    for name, prof in (("HIGH_RISK", K.HIGH_RISK_PROFILE), ("LOW_RISK", K.LOW_RISK_PROFILE)):
        rows.append(tuple([name] + [prof.get(f.name) for f in SCORING_REQUEST.fields[1:]]))
    return spark.createDataFrame(rows, SCORING_REQUEST)


def request_features(requests: DataFrame, cut: float | None = None, serving_compat: bool = False) -> DataFrame:
    """Model features of raw scoring requests.

    By default the training form, with the fiber cut the models were trained
    with (saved beside them, ``models.fitted_cut``): a customer gets the same
    features in a request as in the prepared table. ``serving_compat`` gives
    the serving form (eight service columns, other ratio guard and total,
    fiber cut 70 unless given).
    """
    if serving_compat:
        return serving_features(requests, cut)
    if cut is None:
        raise ValueError("the training form needs the fitted fiber cut")
    total = C.impute_total(F.col("TotalCharges"), "tenure", "MonthlyCharges")
    return engineer(requests.withColumn("TotalCharges", total), cut=cut)


def score_requests(requests: DataFrame, model: PipelineModel, cut: float | None = None, serving_compat: bool = False) -> DataFrame:
    """Raw scoring requests -> scores, on the features of ``request_features``."""
    return score(request_features(requests, cut, serving_compat), model)


def high_risk_check(spark: SparkSession, model: PipelineModel, cut: float) -> DataFrame:
    """Per model, P(churn) of the two profiles; HIGH_RISK must reach 0.6 (C4)."""
    scored = score_requests(profiles_frame(spark), model, cut)
    present = [c[2:] for c in scored.columns if c.startswith("p_")]
    long = scored.select("customer_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("probability")) for m in present
    ] + [F.struct(F.lit("ensemble").alias("model"), F.col("churn_probability").alias("probability"))])).alias("r"))
    return long.select(F.col("customer_id").alias("profile"), "r.model", "r.probability").withColumn(
        "passed", F.when(F.col("profile") == "HIGH_RISK", F.col("probability") >= K.HIGH_RISK_FLOOR)
    )
