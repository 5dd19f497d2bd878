"""Bad rows set aside with their reasons, so that one of them does not end a job.

Two things go wrong with a row: the line does not parse under the fixed schema,
or a value is outside its domain (a category the codes were not fitted on, a
missing or negative number). The batch path still fails on either
(``read_raw_csv``, the indexer's ``handleInvalid="error"``); here both are routed to a second table.

Reasons are column expressions over the row and one small row of domains, so the
test is part of the scan: no shuffle, and no row passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio import constants as K
from retentio.plans.lineage import write_stage
from retentio.schema import RAW_SUBSCRIBERS

CORRUPT = "_line"
MALFORMED = "malformed line"
NUMBERS = ("tenure", "MonthlyCharges")
#: String features that a raw row or a request holds; the others are derived.
CATEGORIES = tuple(f.name for f in RAW_SUBSCRIBERS.fields if f.name in K.STRING_FEATURES)


def read_raw_csv_quarantined(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, lines that do not: key, line, reasons) of a raw CSV file."""
    schema = T.StructType([*RAW_SUBSCRIBERS.fields, T.StructField(CORRUPT, T.StringType(), True)])
    read = (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    # written once: a scan parses the columns it is asked for only, and a line is to be judged as a whole
    read = write_stage(read, "parsed-csv")
    bad = read.where(F.col(CORRUPT).isNotNull())
    # the key is the first field, also where another one does not parse
    lines = bad.select(F.coalesce("customerID", F.split(CORRUPT, ",")[0]).alias("key"), F.col(CORRUPT).alias("line"), F.array(F.lit(MALFORMED)).alias("reasons"))
    return read.where(F.col(CORRUPT).isNull()).drop(CORRUPT), lines


def domains(codes: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row: ``domains``, a map from column to its known values, from the codes table (column_name, value)."""
    known = codes.where(F.col("column_name").isin(list(columns))).groupBy("column_name").agg(F.sort_array(F.collect_set("value")).alias("known"))
    # as many entries as there are category columns
    return known.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "known"))).alias("domains"))


def _reasons(columns: Sequence[str], numbers: Sequence[str]) -> Column:
    tests = []
    for c in columns:
        value = F.col(c)
        tests.append(F.when(value.isNull(), F.lit(f"missing {c}")).when(
            ~F.coalesce(F.array_contains(F.col("domains")[c], value), F.lit(False)), F.concat(F.lit(f"unknown {c}: "), value)))
    for c in numbers:
        value = F.col(c).cast("double")
        tests.append(F.when(value.isNull() | F.isnan(value), F.lit(f"missing {c}")).when(value < 0, F.lit(f"negative {c}")))
    return F.array_compact(F.array(*tests))


def checked(rows: DataFrame, known: DataFrame, columns: Sequence[str] = CATEGORIES, numbers: Sequence[str] = NUMBERS) -> DataFrame:
    """``rows`` with ``reasons``: why each cannot be used; empty for a good row."""
    out = rows.crossJoin(F.broadcast(known))  # one row of domains
    return out.select(*rows.columns, _reasons(columns, numbers).alias("reasons"))


def split_valid(rows: DataFrame, known: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``reasons``)."""
    tested = checked(rows, known, **options)
    return tested.where(F.size("reasons") == 0).drop("reasons"), tested.where(F.size("reasons") > 0)
