"""Fixed values of the churn / lifetime-value domain.

Everything in this module is a business constant that results depend on.
They are stated once, in natural order, and every other module reads them
from here.
"""

from __future__ import annotations

# --- fixed values: subscriber categorical domains (alphabetical order) ---
CATEGORY_DOMAINS: dict[str, tuple[str, ...]] = {
    "gender": ("Female", "Male"),
    "Partner": ("No", "Yes"),
    "Dependents": ("No", "Yes"),
    "PhoneService": ("No", "Yes"),
    "MultipleLines": ("No", "No phone service", "Yes"),
    "InternetService": ("DSL", "Fiber optic", "No"),
    "OnlineSecurity": ("No", "No internet service", "Yes"),
    "OnlineBackup": ("No", "No internet service", "Yes"),
    "DeviceProtection": ("No", "No internet service", "Yes"),
    "TechSupport": ("No", "No internet service", "Yes"),
    "StreamingTV": ("No", "No internet service", "Yes"),
    "StreamingMovies": ("No", "No internet service", "Yes"),
    "Contract": ("Month-to-month", "One year", "Two year"),
    "PaperlessBilling": ("No", "Yes"),
    "PaymentMethod": (
        "Bank transfer (automatic)",
        "Credit card (automatic)",
        "Electronic check",
        "Mailed check",
    ),
    "tenure_bucket": ("0-6m", "12-24m", "24m+", "6-12m"),
}

# --- fixed values: tenure buckets (upper bound in months, inclusive; label) ---
TENURE_BUCKETS: tuple[tuple[int, str], ...] = ((6, "0-6m"), (12, "6-12m"), (24, "12-24m"))
TENURE_BUCKET_LAST = "24m+"

# --- fixed values: services counted per customer ---
# training form counts nine columns, serving form leaves out MultipleLines
SERVICE_COLUMNS_TRAINING: tuple[str, ...] = (
    "PhoneService", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
)
SERVICE_COLUMNS_SERVING: tuple[str, ...] = (
    "PhoneService", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
)
INTERNET_TYPES: tuple[str, ...] = ("DSL", "Fiber optic")

# --- fixed values: contracts and lifetime ---
LONG_CONTRACTS: tuple[str, ...] = ("One year", "Two year")
MONTHLY_CONTRACT = "Month-to-month"
EXPECTED_TENURE_LONG = 24
EXPECTED_TENURE_SHORT = 12
CLV_FALLBACK_MONTHS = 12

# --- fixed values: lifetime-value quartile labels, lowest first ---
QUARTILE_LABELS: tuple[str, ...] = ("Low", "Medium", "High", "Premium")
QUARTILE_PROBS: tuple[float, ...] = (0.25, 0.5, 0.75)

# --- fixed values: thresholds ---
FIBER_HIGH_CHARGE_PERCENTILE = 0.75     # training form of the fiber flag
FIBER_HIGH_CHARGE_SERVING = 70.0        # serving form of the fiber flag
SHORT_TENURE_MONTHS = 12
RATIO_ANOMALY_HIGH = 1.5
RATIO_ANOMALY_LOW = 0.5
RISK_LOW_BELOW = 0.3
RISK_MEDIUM_BELOW = 0.6
RISK_LABELS: tuple[str, ...] = ("Low", "Medium", "High")
IMBALANCE_LOW = 0.15
IMBALANCE_HIGH = 0.40
TRAIN_WEIGHTING_BELOW = 0.30
SPLIT_DRIFT_POINTS = 2.0
RECALL_FLOOR = 0.60
HIGH_RISK_FLOOR = 0.60
HISTOGRAM_BINS = 30
HIGH_QUARTILE_CHURN_CUT = 0.10          # savings scenario: churn in High lowered by 10%

# --- fixed values: split and search ---
SEED = 42
TEST_FRACTION = 0.2
VAL_FRACTION = 0.2
N_FOLDS = 5
LOGISTIC_C_GRID: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
LOGISTIC_MAX_ITER = 1000
FOREST_TREES = 100
FOREST_DEPTH_GRID: tuple[int | None, ...] = (5, 10, 15, None)
FOREST_LEAF_GRID: tuple[int, ...] = (1, 2, 4)
FOREST_UNLIMITED_DEPTH = 30             # deepest tree pyspark.ml accepts
BOOST_ROUNDS = 100
BOOST_DEPTH_GRID: tuple[int, ...] = (3, 5, 7)
BOOST_RATE_GRID: tuple[float, ...] = (0.01, 0.1, 0.2)
TOP_FACTORS = 5

# --- fixed values: model names ---
MODEL_NAMES: tuple[str, ...] = ("logistic", "random_forest", "boosted")

# --- fixed values: model feature order (19 raw, 8 engineered) ---
FEATURE_COLUMNS: tuple[str, ...] = (
    "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges",
    "tenure_bucket", "services_count", "monthly_to_total_ratio",
    "flag_internet_no_tech_support", "flag_fiber_high_charges",
    "flag_short_tenure_monthly", "expected_tenure", "CLV",
)

# --- fixed values: retention priority rule ---
PRIORITY_RETAIN = "Retain"
PRIORITY_MONITOR = "Monitor"
PRIORITY_NURTURE = "Nurture"
PRIORITY_OTHER = "Other"

# --- fixed values: insight sentence formats ---
INSIGHT_WORST = (
    "🚨 CRITICAL: %s CLV customers have the highest churn rate at %.1f%%. These "
    "customers are paying premium prices but are dissatisfied - prioritize "
    "retention efforts here."
)
INSIGHT_BEST = (
    "✅ %s CLV customers have the lowest churn rate at %.1f%%. These are typically "
    "long-term contract customers - contract lock-in is working."
)
INSIGHT_RISK = "💰 %.1f%% of total CLV ($%s) is at risk from churning customers."

# --- fixed values: scoring profiles used by the high-risk check ---
HIGH_RISK_PROFILE: dict[str, object] = {
    "gender": "Male", "SeniorCitizen": 1, "Partner": "No", "Dependents": "No",
    "tenure": 2, "PhoneService": "Yes", "MultipleLines": "No",
    "InternetService": "Fiber optic", "OnlineSecurity": "No", "OnlineBackup": "No",
    "DeviceProtection": "No", "TechSupport": "No", "StreamingTV": "No",
    "StreamingMovies": "No", "Contract": "Month-to-month", "PaperlessBilling": "Yes",
    "PaymentMethod": "Electronic check", "MonthlyCharges": 105.0, "TotalCharges": 210.0,
}
LOW_RISK_PROFILE: dict[str, object] = {
    "gender": "Female", "SeniorCitizen": 0, "Partner": "Yes", "Dependents": "Yes",
    "tenure": 48, "PhoneService": "Yes", "MultipleLines": "Yes",
    "InternetService": "DSL", "OnlineSecurity": "Yes", "OnlineBackup": "Yes",
    "DeviceProtection": "Yes", "TechSupport": "Yes", "StreamingTV": "Yes",
    "StreamingMovies": "Yes", "Contract": "Two year", "PaperlessBilling": "No",
    "PaymentMethod": "Bank transfer (automatic)", "MonthlyCharges": 85.0,
    "TotalCharges": 4080.0,
}

# Columns the encoder turns into codes: all string features, in feature order.
STRING_FEATURES: tuple[str, ...] = tuple(c for c in FEATURE_COLUMNS if c in CATEGORY_DOMAINS)
