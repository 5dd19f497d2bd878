"""Fixed schemas. Nothing in the engine infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw subscriber table (one row per customer). TotalCharges arrives as text
# because blanks are legal in the source; cleaning turns it into a double.
RAW_SUBSCRIBERS = T.StructType([
    T.StructField("customerID", T.StringType(), False),
    T.StructField("gender", T.StringType(), True),
    T.StructField("SeniorCitizen", T.IntegerType(), True),
    T.StructField("Partner", T.StringType(), True),
    T.StructField("Dependents", T.StringType(), True),
    T.StructField("tenure", T.IntegerType(), True),
    T.StructField("PhoneService", T.StringType(), True),
    T.StructField("MultipleLines", T.StringType(), True),
    T.StructField("InternetService", T.StringType(), True),
    T.StructField("OnlineSecurity", T.StringType(), True),
    T.StructField("OnlineBackup", T.StringType(), True),
    T.StructField("DeviceProtection", T.StringType(), True),
    T.StructField("TechSupport", T.StringType(), True),
    T.StructField("StreamingTV", T.StringType(), True),
    T.StructField("StreamingMovies", T.StringType(), True),
    T.StructField("Contract", T.StringType(), True),
    T.StructField("PaperlessBilling", T.StringType(), True),
    T.StructField("PaymentMethod", T.StringType(), True),
    T.StructField("MonthlyCharges", T.DoubleType(), True),
    T.StructField("TotalCharges", T.StringType(), True),
    T.StructField("Churn", T.StringType(), True),
])

RAW_COLUMNS = tuple(f.name for f in RAW_SUBSCRIBERS.fields)

# A scoring request: a raw row without the key and the label; TotalCharges
# may be null and then defaults to tenure x MonthlyCharges.
SCORING_REQUEST = T.StructType(
    [T.StructField("customer_id", T.StringType(), True)]
    + [
        T.StructField(f.name, T.DoubleType() if f.name == "TotalCharges" else f.dataType, True)
        for f in RAW_SUBSCRIBERS.fields
        if f.name not in ("customerID", "Churn")
    ]
)
