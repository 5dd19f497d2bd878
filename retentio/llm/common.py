"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.plans.lineage import write_stage
from retentio.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    return write_stage(df, f"llm-{name}")


def output_root(spark: SparkSession, name: str) -> str:
    """A new folder for written files below the shared checkpoint folder, as a URI."""
    root = os.path.join(ensure_checkpoint_dir(spark), "out", f"{name}-{uuid.uuid4().hex[:12]}")
    return root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of the incoming batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kept(path: str, make):
    """What a worker process has read from ``path``; it outlives a task. Only the last such thing of all operators is kept."""
    held = sys.modules.setdefault("_retentio_llm_kept", types.ModuleType("_retentio_llm_kept")).__dict__
    if held.get("path") != path:
        held.update(path=path, made=None)
        held["made"] = make()
    return held["made"]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def filesystem(uri: str):
    """(file system, path) for a folder that all executors reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def files_of(root: str) -> tuple[object, list[str]]:
    """The file system and the Parquet files of a written table, in the order of their names."""
    from pyarrow import fs as pafs

    fs, folder = filesystem(root)
    return fs, sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet"))


def commit_file(fs, temporary: str, final: str) -> None:
    """Publish a finished file. A retried task writes the same bytes, so replacing is safe."""
    if fs.get_file_info(final).is_file:
        fs.delete_file(final)
    fs.move(temporary, final)


def id_cuts(df: DataFrame, key: str, weight, target: int, fan: int = 64) -> list[int]:
    """Lower ends of the key ranges, after the first, that each weigh about ``target``.

    A function of the rows alone, whatever their partitioning: the key range is
    cut into ``fan`` equal bins, each bin that weighs more than a quarter of
    the target is cut again, and neighbouring bins are joined up to the target.
    The driver gets a few sums per resulting range. One key value is never
    split. Null keys belong to the first range.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.greatest(weight.cast("long"), F.lit(1)).alias("w")).where("k is not null")
    lo, hi = rows.agg(F.min("k"), F.max("k")).first()
    if lo is None:
        return []
    todo, leaves = [(int(lo), int(hi) + 1)], []
    summed = pa.schema([("at", pa.int64()), ("bin", pa.int64()), ("w", pa.int64())])
    while todo:
        todo.sort()
        first = np.array([a for a, _ in todo], np.int64)
        last = np.array([b - 1 for _, b in todo], np.int64)
        width = np.array([-(-(b - a) // fan) for a, b in todo], np.uint64)

        def sums(batches, first=first, last=last, width=width):
            for part in batches:
                k, w = (np.asarray(part.column(c)) for c in ("k", "w"))
                at = np.searchsorted(first, k, side="right") - 1
                keep = (at >= 0) & (k <= last[np.maximum(at, 0)])
                k, w, at = k[keep], w[keep], at[keep]
                bins = (k.view(np.uint64) - first.view(np.uint64)[at]) // width[at]
                cells, place = np.unique(at.astype(np.uint64) * np.uint64(fan) + bins, return_inverse=True)
                weight = np.zeros(len(cells), np.int64)
                np.add.at(weight, place, w)
                yield batch(summed, [(cells // np.uint64(fan)).astype(np.int64), (cells % np.uint64(fan)).astype(np.int64), weight])

        heavy = []
        for at, i, w in rows.mapInArrow(sums, "at long, bin long, w long").groupBy("at", "bin").agg(F.sum("w")).collect():
            start = todo[at][0] + i * int(width[at])
            stop = min(todo[at][1], start + int(width[at]))
            if w > target / 4 and stop - start > 1:
                heavy.append((start, stop))
            else:
                leaves.append((start, w))
        todo = heavy
    cuts, total = [], 0
    for start, w in sorted(leaves):
        if total and total + w > target:
            cuts.append(start)
            total = 0
        total += w
    return cuts


def shard_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """Range number of each id; nulls belong to range 0."""
    values = np.asarray(ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), np.int64)
    return np.searchsorted(cuts, values, side="right").astype(np.int32)
