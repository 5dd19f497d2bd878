"""File sources and sinks: raw CSV in, prepared splits and results out.

* ``read_raw_csv``: the raw subscriber CSV under the fixed schema (never
  inferred: one blank in TotalCharges would change the column type).
* ``write_splits`` / ``read_split``: the prepared table written once,
  partitioned by ``split``; reading one split prunes to its folder.
* ``write_table``: any result table (metrics, codes) as parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.schema import RAW_SUBSCRIBERS


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(RAW_SUBSCRIBERS)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write raw rows as CSV keeping blank-but-present text (e.g. ' ')."""
    (df.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the prepared table partitioned by its ``split`` column."""
    writer = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def read_split(spark: SparkSession, path: str, splits: Sequence[str] | str | None = None) -> DataFrame:
    """Read prepared rows; ``splits`` filters on the partition column."""
    df = spark.read.parquet(path)
    if splits is None:
        return df
    if isinstance(splits, str):
        splits = [splits]
    return df.where(F.col("split").isin(list(splits)))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
