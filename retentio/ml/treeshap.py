"""Per-row attributions for tree ensembles (L15, L16, A26 for trees).

Path-dependent TreeSHAP (Lundberg, Erion and Lee, "Consistent
Individualized Feature Attribution for Tree Ensembles", 2018, Algorithm 2):
exact Shapley values of a tree's output where a missing feature follows
both children in proportion to the training weight that reached them.

Plan: the model is a relation of nodes in the shared folder (``ml.nodes``).
``mapInArrow`` explains each Arrow batch of rows inside the executors; tasks
read the nodes themselves, in groups of whole trees of bounded size, so rows
stay partitioned and neither rows nor nodes reach the driver. Columns that are
wanted beside the explanation are carried through. The global attribution sums
inside the tasks: one row a feature and task is shuffled.

Batch kernel: for one leaf, the algorithm's result depends on a row only
through which of the leaf's path features the row "follows" (a 0/1 pattern
of at most depth bits; repeated features on a path merge). With o and z the
one and zero fractions of the path's k features, feature i gets the leaf's value times
``(o_i - z_i) * sum over S of |S|! (k-1-|S|)! / k! * prod o_S * prod z_rest``, and
since ``|S|! (k-1-|S|)! / k!`` is the integral of ``t^|S| (1-t)^(k-1-|S|)`` over [0, 1],
that sum is the integral of ``prod over j <> i of (o_j t + z_j (1-t))``: a
polynomial of degree k-1, which Gauss-Legendre quadrature with ceil(k/2)
points integrates exactly. A batch is a few array operations a leaf over the patterns that
occur. ``tree_shap`` (the per-row recursion) is kept as the reference the
tests compare the kernel with.

Units: the boosted model is explained in log-odds (MLlib's probability is
``1 / (1 + exp(-2 * margin))``, so log-odds = 2 x margin); the forest in
probability of class 1 (the mean of the trees' leaf class shares). In both,
``base_value + sum(contributions) == output`` for every row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from retentio import constants as K
from retentio.ml.nodes import KEPT_NODES, node_files, tree_groups

# The batch kernel runs inside Python workers. Pickling this module's
# functions by value ships them with each task, so executors need no copy
# of the package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older cloudpickle: by reference
    pass


def _tables(spark: SparkSession, model, kind: str) -> dict:
    """All trees of a model, as the tasks read them (for tests)."""
    return {"trees": [t for group in tree_groups(node_files(spark, model, kind)) for t in group]}


def _extend(path: list, z: float, o: float, d: int) -> list:
    path = [list(e) for e in path]
    depth = len(path)
    path.append([d, z, o, 1.0 if depth == 0 else 0.0])
    for i in range(depth - 1, -1, -1):
        path[i + 1][3] += o * path[i][3] * (i + 1) / (depth + 1)
        path[i][3] = z * path[i][3] * (depth - i) / (depth + 1)
    return path


def _unwind(path: list, idx: int) -> list:
    path = [list(e) for e in path]
    depth = len(path) - 1
    o, z = path[idx][2], path[idx][1]
    nxt = path[depth][3]
    for i in range(depth - 1, -1, -1):
        if o != 0:
            tmp = path[i][3]
            path[i][3] = nxt * (depth + 1) / ((i + 1) * o)
            nxt = tmp - path[i][3] * z * (depth - i) / (depth + 1)
        else:
            path[i][3] = path[i][3] * (depth + 1) / (z * (depth - i))
    for i in range(idx, depth):
        path[i][0], path[i][1], path[i][2] = path[i + 1][0], path[i + 1][1], path[i + 1][2]
    path.pop()
    return path


def _unwound_sum(path: list, idx: int) -> float:
    depth = len(path) - 1
    o, z = path[idx][2], path[idx][1]
    nxt = path[depth][3]
    total = 0.0
    if o != 0:
        for i in range(depth - 1, -1, -1):
            tmp = nxt / ((i + 1) * o)
            total += tmp
            nxt = path[i][3] - tmp * z * (depth - i)
    else:
        for i in range(depth - 1, -1, -1):
            total += path[i][3] / (z * (depth - i))
    return total * (depth + 1)


def _goes_left(x: np.ndarray, tree: tuple, node: int) -> bool:
    """MLlib's rule: continuous x <= threshold; categorical x in left set."""
    left, right, feat, thr, cats, value, cover, scale = tree
    c = cats[node]
    v = x[feat[node]]
    return (float(v) in c) if c is not None else v <= thr[node]


def tree_shap(x: np.ndarray, tree: tuple, phi: np.ndarray) -> None:
    """Add one tree's attributions for row ``x`` into ``phi`` (scaled)."""
    left, right, feat, thr, cats, value, cover, scale = tree

    def recurse(node: int, path: list, z: float, o: float, d: int) -> None:
        path = _extend(path, z, o, d)
        if left[node] < 0:
            for i in range(1, len(path)):
                w = _unwound_sum(path, i)
                phi[path[i][0]] += w * (path[i][2] - path[i][1]) * value[node] * scale
            return
        f = feat[node]
        hot, cold = (left[node], right[node]) if _goes_left(x, tree, node) else (right[node], left[node])
        iz, io = 1.0, 1.0
        for k in range(1, len(path)):
            if path[k][0] == f:
                iz, io = path[k][1], path[k][2]
                path = _unwind(path, k)
                break
        recurse(hot, path, iz * cover[hot] / cover[node], io, f)
        recurse(cold, path, iz * cover[cold] / cover[node], 0.0, f)

    recurse(0, [], 1.0, 1.0, -1)


def _expected(tree: tuple) -> float:
    left, right, feat, thr, cats, value, cover, scale = tree
    leaves = left < 0
    return float((cover[leaves] * value[leaves]).sum() / cover[0] * scale)


def _predict(x: np.ndarray, tree: tuple) -> float:
    left, right, feat, thr, cats, value, cover, scale = tree
    node = 0
    while left[node] >= 0:
        node = left[node] if _goes_left(x, tree, node) else right[node]
    return float(value[node] * scale)


def _leaf_paths(tree: tuple) -> list:
    """Per leaf: value, unique path features (first-seen order), their zero
    fractions, and the split tests that decide each feature's one fraction.

    A feature met several times on the way to a leaf merges into one path
    element: zero fractions multiply, and the one fraction is the AND of the
    tests, which is what the recursion's unwinding computes.
    """
    left, right, feat, thr, cats, value, cover, scale = tree
    leaves = []

    def walk(node: int, tests: list) -> None:
        if left[node] < 0:
            order: list[int] = []
            zero: dict[int, float] = {}
            conds: dict[int, list] = {}
            for f, parent, child, went_left in tests:
                if f not in zero:
                    order.append(f)
                    zero[f] = 1.0
                    conds[f] = []
                zero[f] *= cover[child] / cover[parent]
                conds[f].append((parent, went_left))
            leaves.append((float(value[node]), order, [zero[f] for f in order], [conds[f] for f in order]))
            return
        f = int(feat[node])
        walk(int(left[node]), tests + [(f, node, int(left[node]), True)])
        walk(int(right[node]), tests + [(f, node, int(right[node]), False)])

    walk(0, [])
    return leaves


def _pattern_phi(zeros: np.ndarray, ones: np.ndarray, cache: dict) -> np.ndarray:
    """Weights of a leaf's path features (patterns x features) for on/off patterns ``ones`` of the path."""
    points = (len(zeros) + 1) // 2
    if points not in cache:
        x, w = np.polynomial.legendre.leggauss(points)
        cache[points] = (x + 1) / 2, w / 2
    t, w = cache[points]
    f = ones[:, :, None] * t + zeros[None, :, None] * (1 - t)
    # products of all others from both sides: no division
    rest = np.ones_like(f)
    np.cumprod(f[:, :-1], axis=1, out=rest[:, 1:])
    rest[:, :-1] *= np.cumprod(f[:, :0:-1], axis=1)[:, ::-1]
    return (rest @ w) * (ones - zeros)


def _split_test(x: np.ndarray, tree: tuple, node: int, went_left: bool) -> np.ndarray:
    left, right, feat, thr, cats, value, cover, scale = tree
    col = x[:, feat[node]]
    c = cats[node]
    goes_left = np.isin(col, np.fromiter(c, dtype=float)) if c is not None else col <= thr[node]
    return goes_left if went_left else ~goes_left


def tree_shap_batch(x: np.ndarray, tree: tuple, phi: np.ndarray, leaves: list, cache: dict, out: np.ndarray | None = None) -> None:
    """Add one tree's attributions for every row of ``x`` (n x features) into ``phi``, its outputs into ``out``.

    Vectorized over rows: per leaf, each row's on/off pattern over the
    leaf's path features selects the weights of that pattern.
    ``cache`` keeps quadrature points by their number.
    """
    scale = tree[-1]
    goes = {n: _split_test(x, tree, n, True) for n in np.flatnonzero(tree[0] >= 0).tolist()}
    for v, order, zeros, conds in leaves:
        if not order:
            if out is not None:
                out += v * scale
            continue
        pattern = np.zeros(len(x), np.int64)
        for k, tests in enumerate(conds):
            ok = np.ones(len(x), bool)
            for node, went_left in tests:
                ok &= goes[node] if went_left else ~goes[node]
            pattern |= ok.astype(np.int64) << k
        if out is not None:
            out[pattern == (1 << len(order)) - 1] += v * scale
        found, at = np.unique(pattern, return_inverse=True)
        ones = ((found[:, None] >> np.arange(len(order))) & 1).astype(float)
        phi[:, order] += _pattern_phi(np.asarray(zeros), ones, cache)[at] * (v * scale)


def predict_batch(x: np.ndarray, tree: tuple) -> np.ndarray:
    left, right, feat, thr, cats, value, cover, scale = tree
    node = np.zeros(x.shape[0], dtype=np.int64)
    active = left[node] >= 0
    while active.any():
        idx = np.nonzero(active)[0]
        for n in np.unique(node[idx]):
            sel = idx[node[idx] == n]
            goes = _split_test(x[sel], tree, int(n), True)
            node[sel] = np.where(goes, left[n], right[n])
        active = left[node] >= 0
    return value[node] * scale


class Explainer:
    """Explains batches of rows with the trees of a node relation."""

    def __init__(self, nodes: str):
        self.nodes = nodes
        self.base = 0.0
        self.quadrature: dict = {}
        kept, held = [], 0
        for group in tree_groups(nodes):
            self.base += sum(_expected(t) for t in group)
            held += sum(len(t[0]) for t in group)
            if held <= KEPT_NODES:
                kept.append(self._ready(group))
        self.kept = kept if held <= KEPT_NODES else None

    @staticmethod
    def _ready(group: list[tuple]) -> list[tuple]:
        return [(t, _leaf_paths(t)) for t in group]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(output, contributions) of each row."""
        phi, out = np.zeros(x.shape), np.zeros(len(x))
        if not len(x):
            return out, phi
        # a larger model is read again for each batch, group by group
        for group in self.kept if self.kept is not None else map(self._ready, tree_groups(self.nodes)):
            for tree, paths in group:
                tree_shap_batch(x, tree, phi, paths, self.quadrature, out)
        return out, phi


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column that hold a whole number of features without NaN, and which rows they are."""
    n = len(column)
    if n == column.null_count:
        return np.zeros((0, 0)), np.zeros(n, bool)
    width = len(column.flatten()) // max(1, n - column.null_count)
    x = np.full((n, width), np.nan)
    x[~np.asarray(column.is_null())] = np.asarray(column.flatten()).reshape(-1, width)
    there = ~np.isnan(x).any(axis=1)
    return x[there], there


def spread(rows: DataFrame, key: str) -> DataFrame:
    """At least a partition for each core: explaining a row costs far more than moving it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def attributions(rows: DataFrame, model=None, kind: str = "boosted", features_col: str = "features",
                 key: str = "customer_id", carry: tuple[str, ...] = (), nodes: str | None = None) -> DataFrame:
    """``key``, the ``carry`` columns, base_value, output, contributions array<double> per row.

    ``kind`` is "boosted" (log-odds units) or "forest" (probability units).
    ``rows`` must carry the assembled feature vector (or an array of the features); a row whose features hold
    NaN gets a null output and null contributions. ``nodes`` is the folder
    of a written node relation; without it the nodes of ``model`` are written.
    """
    nodes = nodes or node_files(rows.sparkSession, model, kind)
    kept = [key, *carry]
    src = spread(rows.select(*kept, _features(rows, features_col).alias("_x")), key)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explainer = None
        for part in batches:
            explainer = explainer or Explainer(nodes)
            x, there = _vectors(part.column("_x"))
            out, phi = explainer(x)
            place = np.cumsum(there) - 1
            output = pa.array(out[place] if len(out) else np.zeros(len(there)), mask=~there)
            offsets = pa.array(np.concatenate([[0], np.cumsum(there * (phi.shape[1] if len(phi) else 0))]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(phi.ravel()), mask=pa.array(~there))
            base = pa.array(np.full(len(there), explainer.base))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), base, output, lists], names=[*kept, "base_value", "output", "contributions"])

    schema = StructType([*src.schema.fields[:-1], StructField("base_value", DoubleType()), StructField("output", DoubleType()), StructField("contributions", ArrayType(DoubleType()))])
    return src.mapInArrow(explain, schema)


def attribution_means(rows: DataFrame, model=None, kind: str = "boosted", features_col: str = "features", nodes: str | None = None) -> DataFrame:
    """position, mean_abs_attribution over all rows (L16, A26): summed in the tasks, a row a feature and task moves."""
    nodes = nodes or node_files(rows.sparkSession, model, kind)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explainer, sums, n = None, 0.0, 0
        for part in batches:
            explainer = explainer or Explainer(nodes)
            x, _ = _vectors(part.column("_x"))
            if len(x):
                sums, n = sums + np.abs(explainer(x)[1]).sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums), pa.array(np.full(len(sums), n))], names=["position", "s", "n"])

    src = spread(rows.select(_features(rows, features_col).alias("_x")), "_x")
    summed = src.mapInArrow(total, "position int, s double, n long")
    return summed.groupBy("position").agg((F.sum("s") / F.sum("n")).alias("mean_abs_attribution"))


def _features(rows: DataFrame, name: str) -> F.Column:
    return F.col(name).cast("array<double>") if isinstance(rows.schema[name].dataType, ArrayType) else vector_to_array(F.col(name))


def contribution_structs(contributions: F.Column) -> F.Column:
    """Pair contributions with feature names and positions."""
    names = F.array(*[F.lit(f) for f in K.FEATURE_COLUMNS])
    return F.transform(contributions, lambda c, i: F.struct(
        i.alias("position"), names[i].alias("feature"), c.alias("contribution")
    ))
