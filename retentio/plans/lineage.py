"""Cutting lineage so a lost executor does not replay a whole plan.

Uses reliable checkpoints in the folder the cluster names in
``spark.checkpoint.dir`` (shared storage). Local checkpoints are never used:
they live on executor disks and die with them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from retentio.session import ensure_checkpoint_dir


def path_exists(spark, path: str) -> bool:
    """Existence check through Hadoop's FileSystem (local, HDFS or object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder, for results this session needs for a while."""
    path = os.path.join(ensure_checkpoint_dir(spark), "stages", f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark) -> list[str]:
    """Delete the scratch folders of this application; returns those that were there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = []
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).delete(p, True):
            gone.append(path)
    return gone


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def write_stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Use for results that several later jobs read (the prepared subscriber
    table before model training): the read-back plan starts at the files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)
