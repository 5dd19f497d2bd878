"""Corpus pipeline: named stages over ``documents``, each written and read again.

1. toxicity: documents scored as toxic go.
2. n-gram Jaccard join: of each group of linked documents one stays, that of
   the smallest doc_id (of rows equal in doc_id and text, one).
3. benchmark decontamination: documents holding a benchmark window go.
4. mixing: each document stays as often as the mix of its source takes it.
5. token-ID / binary output: what is left is written as token records.

Stages work on all rows their predecessor kept and, but for the last, return
the columns of their input. An empty table passes through; null texts are
empty texts (one group in stage 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.chosen_path import first_of_groups
from retentio.llm.common import settle, table
from retentio.llm.mixing import take
from retentio.llm.positions import contamination
from retentio.llm.tokens import token_records
from retentio.llm.toxicity import fit, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    kept = score(docs, model, out="_toxicity").where("_toxicity.predicted = 0")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("text_md5").alias("_md5")).distinct()
    # the verdict is a function of the text; contaminated texts are few, and the planner sees their size
    hit = settle(hit, "contaminated")
    keyed = docs.withColumn("_own", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return keyed.join(hit, F.col("_own") == F.col("_md5"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of what is left."""
    return token_records(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Fitted scores and a byte-pair vocabulary have no SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
