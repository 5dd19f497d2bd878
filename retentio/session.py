"""Session helpers for tests, the bench and command-line use.

Library functions never build a session; they take the caller's, and so do
the batch jobs. ``local_session`` is for tests and the bench only: it takes
an active session as it is, and else builds a local one.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cpus: int | None = None, app: str = "retentio") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder comes from the session configuration and is
    shared storage. Only when nothing is configured and the master is local
    (tests) a folder is set here; executors elsewhere would not share it.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master) and not fallback:
            raise ValueError(f"spark.checkpoint.dir is not set: master {sc.master} needs a folder that all executors share")
        configured = fallback or os.path.join(os.environ.get("TMPDIR", "/tmp"), "retentio-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
