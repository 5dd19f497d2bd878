"""Classifier metrics from scored rows.

Input: long rows ``(model, label, score)`` (plus anything else). Everything
is grouped by model, so several models are measured in one pass.

AUC and ROC are exact with ties: rows collapse to distinct (model, score)
with positive / negative counts (partial aggregation), then running counts
below each score come from the distributed running-total plan. With
``bins`` the score is first floored to ``bins`` equal steps, which bounds
the distinct scores per model for very large tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.functions import columns as C
from retentio.plans.broadcast import broadcast_bounded
from retentio.plans.lineage import checkpoint
from retentio.plans.ordered import running_totals


def predictions(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class 1 when the score is above the threshold (a probability-argmax)."""
    return scored.withColumn("prediction", F.when(F.col("score") > threshold, F.lit(1)).otherwise(F.lit(0)))


def score_counts(scored: DataFrame, bins: int | None = None, materialize: bool = True) -> DataFrame:
    """(model, score, pos, neg): the one pass over scored rows every metric uses.

    Rows collapse to distinct scores per model with map-side partial sums.
    The collapsed table is checkpointed (shared storage) because the
    confusion counts, the bucket bounds and the running totals all read it.
    """
    s = F.col("score").cast("double")
    if bins:
        s = F.floor(s * bins) / F.lit(float(bins))
    counts = scored.select("model", s.alias("score"), F.col("label")).groupBy("model", "score").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )
    return checkpoint(counts) if materialize else counts


def _counts(scored_or_counts: DataFrame, bins: int | None) -> DataFrame:
    cols = set(scored_or_counts.columns)
    return scored_or_counts if {"pos", "neg"} <= cols else score_counts(scored_or_counts, bins)


def confusion_matrix(scored: DataFrame, threshold: float = 0.5, bins: int | None = None) -> DataFrame:
    """tn, fp, fn, tp per model (A22), from the collapsed score counts."""
    c = _counts(scored, bins)
    above = F.col("score") > threshold
    return c.groupBy("model").agg(
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("long").alias("tp"),
    )


def _below(counts: DataFrame) -> DataFrame:
    return running_totals(
        counts, ["score"], {"pos_below": "pos", "neg_below": "neg"}, strata=["model"], inclusive=False
    )


def auc(scored: DataFrame, bins: int | None = None) -> DataFrame:
    """Area under the ROC curve per model (A24), ties counted as half.

    AUC = sum(pos * (2 * negatives_below + neg)) / (2 * P * N).
    """
    b = _below(_counts(scored, bins))
    agg = b.groupBy("model").agg(
        F.sum(F.col("pos") * (F.lit(2) * F.col("neg_below") + F.col("neg"))).alias("_num"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
    )
    return agg.select(
        "model",
        # null where a model has one class only
        F.try_divide(F.col("_num").cast("double"), F.lit(2.0) * F.col("_p").cast("double") * F.col("_n").cast("double")).alias("auc_roc"),
    )


def roc_curve(scored: DataFrame, bins: int | None = None) -> DataFrame:
    """One ROC point per distinct score (A25): rows with score >= threshold are positive.

    Each curve starts at (0, 0), with a null threshold: no row is positive. A
    rate over an empty class is null.
    """
    c = _counts(scored, bins)
    b = _below(c)
    totals = c.groupBy("model").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rate = lambda n, below: F.try_divide((F.col(n) - below).cast("double"), F.col(n).cast("double"))
    points = b.join(broadcast_bounded(totals, 10_000), "model").select(
        "model", F.col("score").alias("threshold"),
        rate("N", F.col("neg_below")).alias("fpr"), rate("P", F.col("pos_below")).alias("tpr"),
    )
    start = totals.select("model", F.lit(None).cast("double").alias("threshold"), rate("N", F.col("N")).alias("fpr"), rate("P", F.col("P")).alias("tpr"))
    return points.unionByName(start)


def classification_metrics(scored: DataFrame, threshold: float = 0.5, bins: int | None = None) -> DataFrame:
    """precision, recall, f1, auc_roc and the recall check per model.

    A ratio with a zero denominator is 0. Everything comes from one
    collapsed pass over the scored rows.
    """
    c = _counts(scored, bins)
    cm = confusion_matrix(c, threshold)
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    m = cm.select(
        "model",
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1"),
    )
    out = m.join(auc(c), "model")
    return out.withColumn("recall_ok", F.col("recall") >= K.RECALL_FLOOR)


def model_comparison(metrics: DataFrame, baseline: str) -> DataFrame:
    """Best model by AUC and each model against the baseline.

    Ties for best go to the model name that sorts first. ``metrics`` has one
    row per model, so the comparison is a window over that small table and
    the metrics plan runs once.
    """
    from pyspark.sql import Window
    every = Window.partitionBy()  # one row per model: bounded by the model count
    best = F.min_by("model", F.struct(-F.col("auc_roc"), F.col("model"))).over(every)
    base = F.max(F.when(F.col("model") == baseline, F.col("auc_roc"))).over(every)
    return metrics.select(
        "model", "precision", "recall", "f1", "auc_roc",
        (F.col("model") == best).alias("is_best"),
        F.when(F.col("model") == baseline, F.lit(None).cast("boolean"))
        .otherwise(F.col("auc_roc") > base).alias("beats_baseline"),
    )


def risk_levels(scored: DataFrame) -> DataFrame:
    """Risk level per scored row."""
    return scored.withColumn("risk_level", C.risk_level("score"))


# --- closed-form scores: a deterministic stand-in for a trained model --------

PROXY_BASELINE = "proxy_tenure_cycle"


def proxy_scores(prepared: DataFrame) -> DataFrame:
    """Three closed-form scores per customer in long form (model, label, score).

    They let metric plans be checked exactly against SQL with many ties:
    ``(tenure % 20) / 20``, ``services_count / 9`` and ``1 - tenure / 72``.
    """
    tenure = F.col("tenure")
    scores = F.array(
        F.struct(F.lit(PROXY_BASELINE).alias("model"), ((tenure % 20).cast("double") / F.lit(20.0)).alias("score")),
        F.struct(F.lit("proxy_services").alias("model"), (F.col("services_count").cast("double") / F.lit(9.0)).alias("score")),
        F.struct(F.lit("proxy_tenure").alias("model"),
                 (F.lit(1.0) - F.least(tenure, F.lit(72)).cast("double") / F.lit(72.0)).alias("score")),
    )
    return prepared.select("customer_id", F.col("Churn").alias("label"), F.explode(scores).alias("s")).select(
        "customer_id", "s.model", "label", "s.score"
    )
