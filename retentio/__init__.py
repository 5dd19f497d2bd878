"""retentio: subscriber churn and lifetime-value analytics on Spark.

Typical flow (every step takes and returns DataFrames)::

    ws = open_workspace(spark, data_dir)       # clean, features, CLV quartiles, split
    churn_by_quartile(ws.report_rows())        # reports on train + test rows
    trained = train_models(ws.prepared)        # logistic / forest / boosted, 5-fold CV
    scores = score(rows, trained.combined())   # batch, one row, or a stream
    top_factors(ws.encoded, stats)             # per-customer explanations
"""

from retentio.ml.models import TrainedModels, load, save, train_models
from retentio.ml.scoring import high_risk_check, score, score_requests
from retentio.operators.attribution import feature_stats, linear_contributions, top_factors
from retentio.operators.metrics import auc, classification_metrics, confusion_matrix, model_comparison, roc_curve
from retentio.operators.prepare import clean, engineer, fit_cuts, prepare, serving_features
from retentio.operators.reports import (
    business_insights,
    churn_by_quartile,
    churn_rate_by_quartile,
    clv_by_churn,
    clv_histogram,
    high_quartile_savings,
    quartile_stats,
    retention_priority,
    revenue_at_risk,
)
from retentio.operators.split import assign_split, sample_rows
from retentio.workspace import Workspace
from retentio.workspace import workspace as open_workspace  # the submodule keeps the name

__all__ = [
    "TrainedModels", "Workspace", "assign_split", "auc", "business_insights", "churn_by_quartile",
    "churn_rate_by_quartile", "classification_metrics", "clean", "clv_by_churn", "clv_histogram",
    "confusion_matrix", "engineer", "feature_stats", "fit_cuts", "high_quartile_savings", "high_risk_check",
    "linear_contributions", "load", "model_comparison", "prepare", "quartile_stats", "retention_priority",
    "revenue_at_risk", "roc_curve", "sample_rows", "save", "score", "score_requests", "serving_features",
    "top_factors", "train_models", "open_workspace",
]
