"""Tree models as a relation: one row per node, read by the tasks that explain.

``tree, node, left, right, feature, threshold, categories, value, cover, scale``:
a leaf has ``left`` -1; a numeric split sends ``x <= threshold`` left, a categorical one
(``categories`` not null) the listed codes; ``cover`` is the training weight that
reached the node, ``scale`` what a tree's value counts in the model's output
(boosted: log-odds, MLlib's probability is ``1 / (1 + exp(-2 * margin))``; forest: probability).

The rows come from the files MLlib saves, or from anywhere else, and are written so that
a tree lies in one file, its nodes in order. Tasks read them in groups of whole trees of at most
``GROUP_NODES`` nodes, so neither the driver nor a task needs the whole model.
"""

from __future__ import annotations

import math
import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.plans.files import parquet_files
from retentio.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # runs in Python workers

NODES = "tree int, node int, left int, right int, feature int, threshold double, categories array<double>, value double, cover double, scale double"
#: Nodes of trees that a task holds at once, and up to which it keeps them between batches.
GROUP_NODES, KEPT_NODES = 100_000, 400_000
FILE_NODES = 200_000


def saved_nodes(spark: SparkSession, data: str, weights: list[float], kind: str) -> DataFrame:
    """Nodes of a saved tree model: ``data`` is its folder of that name (a glob will do)."""
    forest = kind == "forest"
    scales = [1.0 / len(weights) if forest else 2.0 * w for w in weights]
    scale = spark.createDataFrame(list(enumerate(scales)), "tree int, scale double")  # a row per tree
    n = F.col("nodeData")
    stats = n["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    of_class = F.when((total > 0) & (F.size(stats) > 1), stats[1] / total).otherwise(F.lit(0.0))
    split, by_category = n["split"], n["split"]["numCategories"] > 0
    values = split["leftCategoriesOrThreshold"]
    rows = spark.read.parquet(data).select(
        F.col("treeID").cast("int").alias("tree"), n["id"].cast("int").alias("node"), n["leftChild"].cast("int").alias("left"), n["rightChild"].cast("int").alias("right"),
        split["featureIndex"].cast("int").alias("feature"), F.when(~by_category & (F.size(values) > 0), values[0]).otherwise(F.lit(0.0)).alias("threshold"),
        F.when(by_category, values).alias("categories"), (of_class if forest else n["prediction"]).alias("value"), (total if forest else stats[0]).alias("cover"))
    return rows.join(F.broadcast(scale), "tree")  # a row per tree


def write_nodes(nodes: DataFrame, path: str) -> str:
    """Write a node relation for the tasks that read it."""
    files = max(1, math.ceil(nodes.count() / FILE_NODES))
    nodes.repartition(files, "tree").sortWithinPartitions("tree", "node").write.mode("overwrite").parquet(path)
    return path


_WRITTEN: dict[tuple, str] = {}


def node_files(spark: SparkSession, model, kind: str) -> str:
    """The written nodes of a model in hand, once per session."""
    key = (spark.sparkContext.applicationId, model.uid, kind)
    if key not in _WRITTEN:
        root = os.path.join(ensure_checkpoint_dir(spark), "models", f"{kind}-{uuid.uuid4().hex[:12]}")
        model.write().overwrite().save(f"{root}/model")
        _WRITTEN[key] = write_nodes(saved_nodes(spark, f"{root}/model/data", list(model.treeWeights), kind), f"{root}/nodes")
    return _WRITTEN[key]


def _tree(rows: dict[str, list]) -> tuple:
    """(left, right, feature, threshold, categories, value, cover, scale) of one tree, indexed by node."""
    at = np.array(rows["node"], np.int64)
    n = int(at.max()) + 1
    left, right, feature = (np.full(n, -1, np.int64) for _ in range(3))
    threshold, value, cover = (np.zeros(n) for _ in range(3))
    for out, name in ((left, "left"), (right, "right"), (feature, "feature"), (threshold, "threshold"), (value, "value"), (cover, "cover")):
        out[at] = rows[name]
    categories: list = [None] * n
    for i, codes in zip(rows["node"], rows["categories"], strict=True):
        categories[i] = None if codes is None else frozenset(codes)
    return left, right, feature, threshold, categories, value, cover, rows["scale"][0]


def tree_groups(path: str, group_nodes: int = GROUP_NODES) -> Iterator[list[tuple]]:
    """Groups of whole trees of a written node relation, of about ``group_nodes`` nodes each."""
    fs, files = parquet_files(path)
    group, held = [], 0
    for name in files:
        open_: dict[str, list] = {}
        with fs.open_input_file(name) as f:
            for part in pq.ParquetFile(f).iter_batches(batch_size=group_nodes):
                trees = np.asarray(part.column("tree"))
                starts = np.flatnonzero(np.concatenate([[True], trees[1:] != trees[:-1]])) if len(trees) else []
                for a, b in zip(starts, [*starts[1:], len(trees)], strict=True):
                    rows = part.slice(a, b - a).to_pydict()
                    if open_ and open_["tree"][0] == rows["tree"][0]:
                        open_ = {k: open_[k] + v for k, v in rows.items()}
                        continue
                    if open_:
                        group.append(_tree(open_))
                        held += len(group[-1][0])
                        if held >= group_nodes:
                            yield group
                            group, held = [], 0
                    open_ = rows
        if open_:
            group.append(_tree(open_))
            held += len(group[-1][0])
            if held >= group_nodes:
                yield group
                group, held = [], 0
    if group:
        yield group
