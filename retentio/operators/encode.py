"""Alphabetical label encoding of the string features (D12, D13, J2, IO4).

``StringIndexer`` with ``stringOrderType="alphabetAsc"`` gives each value its
position in the sorted list of distinct values: the codes of a label
encoder. The fit is a distributed distinct-count; only the value lists
(bounded by the category domains) reach the driver. ``handleInvalid="error"``
makes an unseen value fail, as a dictionary miss would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio import constants as K

SUFFIX = "__code"


NON_FEATURE_STRINGS = ("customer_id", "customerID", "CLV_quartile", "split", "Churn")


def string_columns(df: DataFrame, exclude: Sequence[str] = NON_FEATURE_STRINGS) -> list[str]:
    """String-typed columns of ``df`` in schema order, keys and labels left out."""
    from pyspark.sql.types import StringType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def label_indexer(columns: Sequence[str] = K.STRING_FEATURES) -> StringIndexer:
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[f"{c}{SUFFIX}" for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="error",
    )


def fit_codes(df: DataFrame, columns: Sequence[str] = K.STRING_FEATURES) -> StringIndexerModel:
    return label_indexer(columns).fit(df)


def encode(df: DataFrame, model: StringIndexerModel) -> DataFrame:
    """Replace each string feature by its integer code (same column name)."""
    out = model.transform(df)
    cols = model.getInputCols()
    return out.select(
        *[F.col(f"{c}{SUFFIX}").cast("int").alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def codes_table(spark: SparkSession, model: StringIndexerModel) -> DataFrame:
    """(column_name, value, code) for every fitted value."""
    rows = [
        (col, value, code)
        for col, labels in zip(model.getInputCols(), model.labelsArray)
        for code, value in enumerate(labels)
    ]
    return spark.createDataFrame(rows, "column_name string, value string, code int")
