"""A stream sink whose batches count once, and whose bad requests are set aside.

``foreachBatch`` gives every micro-batch a number that a restart repeats. Each
batch writes its own folder (overwritten if it was begun before) and is then
committed by creating ``_commits/<number>``. Readers see committed
folders only, and a batch that is already committed is skipped. So a stop at any
place, also between the write and the commit, neither loses nor repeats a row.

Layout: ``<sink>/batch=<number>/scored``, ``<sink>/batch=<number>/rejected``, ``<sink>/_commits``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from retentio.ml.scoring import score_requests
from retentio.session import ensure_checkpoint_dir
from retentio.sources.quarantine import split_valid


class CommitLog:
    """Numbers of finished batches, as files of the sink's folder."""

    def __init__(self, spark: SparkSession, sink: str):
        self.sink = sink.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.sink).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def has(self, batch: int) -> bool:
        return bool(self._fs.exists(self._path(f"{self.sink}/_commits/{batch:012d}")))

    def add(self, batch: int) -> None:
        self._fs.create(self._path(f"{self.sink}/_commits/{batch:012d}"), True).close()

    def batches(self) -> list[int]:
        folder = self._path(f"{self.sink}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())


def batch_writer(spark: SparkSession, sink: str, work: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the tables ``work`` makes of a batch, once."""
    log = CommitLog(spark, sink)

    def write(batch: DataFrame, number: int) -> None:
        if log.has(number):
            return
        for name, rows in work(batch).items():
            rows.write.mode("overwrite").parquet(f"{sink}/batch={number}/{name}")
        log.add(number)

    return write


def read_committed(spark: SparkSession, sink: str, name: str = "scored") -> DataFrame | None:
    """The rows of all committed batches; None before the first."""
    paths = [f"{sink}/batch={n}/{name}" for n in CommitLog(spark, sink).batches()]  # a folder a batch
    return spark.read.parquet(*paths) if paths else None


def scoring_work(model: PipelineModel, known: DataFrame, cut: float) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """Scores of the valid requests of a batch, and the others with their reasons."""

    def work(requests: DataFrame) -> dict[str, DataFrame]:
        good, bad = split_valid(requests, known)
        return {"scored": score_requests(good, model, cut), "rejected": bad.select("customer_id", "reasons")}

    return work


def start_batches(requests: DataFrame, sink: str, work: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Run ``work`` on a request stream; give the same ``checkpoint`` and ``sink`` to go on after a stop."""
    spark = requests.sparkSession
    checkpoint = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex[:12])
    writer = requests.writeStream.foreachBatch(batch_writer(spark, sink, work)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
