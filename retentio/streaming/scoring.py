"""Scoring as a Structured Streaming job (L11 on a stream).

Scoring is stateless (a projection through the fitted ``PipelineModel``),
so a stream needs no watermark or state store: each micro-batch of new
request files gets the features the models were trained on and is scored
exactly like a batch. The sink is parquet with a checkpoint under the shared checkpoint
folder, so a restarted query resumes after the last committed batch.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from retentio.ml.scoring import score_requests
from retentio.schema import SCORING_REQUEST
from retentio.session import ensure_checkpoint_dir


def request_stream(spark: SparkSession, source: str, schema: StructType = SCORING_REQUEST,
                   fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source)


def start_scoring(requests: DataFrame, model: PipelineModel, sink: str, checkpoint: str | None = None,
                  available_now: bool = True, cut: float | None = None, serving_compat: bool = False) -> StreamingQuery:
    """Score a request stream into parquet files at ``sink``."""
    spark = requests.sparkSession
    checkpoint = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex[:12])
    writer = (
        score_requests(requests, model, cut, serving_compat).writeStream.format("parquet")
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(sink)


def score_files_once(spark: SparkSession, source: str, model: PipelineModel, sink: str | None = None,
                     cut: float | None = None, serving_compat: bool = False) -> DataFrame:
    """Run the stream over every file present now, then return the sink table."""
    sink = sink or os.path.join(ensure_checkpoint_dir(spark), "stream-out", uuid.uuid4().hex[:12])
    q = start_scoring(request_stream(spark, source), model, sink, cut=cut, serving_compat=serving_compat)
    q.awaitTermination()
    return spark.read.parquet(sink)
