"""A small fixed ensemble as a node relation, scored and explained by the same code as fitted ones.

Three trees over five features stand in a table like any model's nodes; their
covers are the training rows that reach each node, counted in one pass. They need no fit, so
scores and contributions can be checked against SQL that enumerates
all subsets of a tree's features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.ml.nodes import NODES
from retentio.ml.treeshap import attributions


@dataclass(frozen=True)
class Split:
    """``value <= threshold``, or the code is one of ``codes``, goes left."""

    feature: str
    left: Split | float
    right: Split | float
    threshold: float = 0.0
    codes: tuple[int, ...] = ()


#: Leaves are margins; the ensemble's output is half their sum.
TREES: tuple[Split, ...] = (
    Split("Contract", Split("tenure", 1.5, 0.25, threshold=12.0), -1.0, codes=(0,)),
    Split("MonthlyCharges", Split("Contract", -0.25, -0.75, codes=(0, 1)), Split("InternetService", 0.125, Split("tenure", 1.25, 0.5, threshold=24.0), codes=(0, 2)), threshold=70.0),
    Split("tenure", Split("tenure", 0.75, 0.375, threshold=6.0), Split("TotalCharges", 0.25, -0.5, threshold=2000.0), threshold=36.0),
)
SCALE = 0.5


def leaves(tree: Split | float, path: tuple = ()) -> list[tuple[float, tuple]]:
    """(value, ((split, went left), ...)) of each leaf, from left to right."""
    if not isinstance(tree, Split):
        return [(tree, path)]
    return leaves(tree.left, (*path, (tree, True))) + leaves(tree.right, (*path, (tree, False)))


def _goes(split: Split, left: bool) -> Column:
    test = F.col(split.feature).isin(*split.codes) if split.codes else F.col(split.feature) <= split.threshold
    return test if left else ~test


def node_table(train: DataFrame) -> DataFrame:
    """The node relation of ``TREES``, with covers from the encoded training rows."""
    counts, nodes = [], []

    def walk(tree: int, part: Split | float, number: list[int], conds: Column) -> tuple[int, int]:
        me = number[0]
        number[0] += 1
        place = len(counts)
        counts.append(F.count_if(conds).cast("double"))
        if not isinstance(part, Split):
            nodes.append((tree, me, -1, -1, -1, 0.0, None, part, place))
            return me, place
        left, _ = walk(tree, part.left, number, conds & _goes(part, True))
        right, _ = walk(tree, part.right, number, conds & _goes(part, False))
        codes = [float(c) for c in part.codes] or None
        nodes.append((tree, me, left, right, K.FEATURE_COLUMNS.index(part.feature), part.threshold, codes, 0.0, place))
        return me, place

    for t, tree in enumerate(TREES):
        walk(t, tree, [0], F.lit(True))
    spark = train.sparkSession
    covers = train.agg(F.array(*counts).alias("covers"))  # one row: a count for each node
    literal = spark.createDataFrame(nodes, "tree int, node int, left int, right int, feature int, threshold double, categories array<double>, value double, place int")
    names = [f.split()[0] for f in NODES.split(", ")]
    return literal.crossJoin(F.broadcast(covers)).select(*[
        F.col("covers")[F.col("place")].alias("cover") if n == "cover" else F.lit(SCALE).alias("scale") if n == "scale" else F.col(n) for n in names])


def feature_vector() -> Column:
    return F.array(*[F.col(f).cast("double") for f in K.FEATURE_COLUMNS])


def explained(rows: DataFrame, nodes: str) -> DataFrame:
    """customer_id, base_value, output, contributions of encoded rows."""
    return attributions(rows.select("customer_id", feature_vector().alias("features")), nodes=nodes)
