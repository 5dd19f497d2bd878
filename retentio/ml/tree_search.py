"""Search of the tree models: every (point, fold) fit is a task of one Spark job.

A fit by ``pyspark.ml`` is hundreds of small jobs, one for each level of each
tree, and the published grids ask for 105 such fits. Choosing parameters does
not need every row of a large table, so the search takes a bounded, documented
part of the training rows (``SEARCH_ROWS``, by a hash of the customer; a table of
fewer rows takes part as a whole) and gives each task whole fits on it. The
chosen models are then fitted by ``pyspark.ml`` on all training rows.

The trees follow the same rules as those final fits: ``BINS`` bins a feature,
categories ordered by their mean response in a node, variance (for classes: Gini) gains,
Poisson bootstrap and square-root feature picks for the forest, residuals of the
log-loss with a first tree of full weight for the boosted model. Levels are
grown in one pass over all trees of a group with histograms by ``bincount``.

A forest grown to the largest depth holds the shallower ones: growth is
greedy from the top and draws are made node by node, so a tree cut at depth d
is a tree grown to depth d. One growth scores all depths of the grid.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # runs in Python workers

#: Bound of the rows a search fits on; bins a feature, as many as the final fits use.
SEARCH_ROWS, BINS = 50_000, 32
#: Nodes whose histograms are held at once, rows of the trees that grow together.
SLICE, GROUP_ROWS = 4096, 400_000


@dataclass(frozen=True)
class Rows:
    """The rows of a search: bins (n x k), label 0/1, fold, and the weights of forest and boosted model."""

    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    balanced: np.ndarray
    boost: np.ndarray
    categorical: np.ndarray


def binned(x: np.ndarray, categorical: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Bin of each value: categories as they are, numbers by midpoints of at most ``bins`` quantiles."""
    out = np.zeros(x.shape, np.uint8)
    for j in range(x.shape[1]):
        if categorical[j]:
            if x[:, j].max(initial=0) >= bins:
                raise ValueError(f"feature {j} has more than {bins} categories")
            out[:, j] = x[:, j]
            continue
        values = np.unique(x[:, j])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, j], np.arange(bins) / (bins - 1), method="inverted_cdf"))
        out[:, j] = np.searchsorted((values[1:] + values[:-1]) / 2, x[:, j], side="left")
    return out


def collect_rows(train: DataFrame, features: str, label: str, balanced: str, boost: str, categorical: list[bool]) -> Rows:
    """The (bounded) search rows as arrays."""
    from pyspark.ml.functions import vector_to_array

    t = train.select(vector_to_array(features).alias("x"), label, "fold", balanced, boost).toArrow()
    x = np.asarray(t.column("x").combine_chunks().flatten()).reshape(t.num_rows, len(categorical))
    flags = np.array(categorical)
    number = lambda c, kind: t.column(c).to_numpy().astype(kind)
    return Rows(binned(x, flags), number(label, np.float64), number("fold", np.int64), number(balanced, np.float64), number(boost, np.float64), flags)


def auc(label: np.ndarray, score: np.ndarray) -> float | None:
    """Area under the ROC curve, ties as half; None with one class."""
    names, at = np.unique(score, return_inverse=True)
    pos, neg = (np.bincount(at, label == c, len(names)) for c in (1, 0))
    if not pos.sum() or not neg.sum():
        return None
    return float((pos * (np.cumsum(neg) - neg + neg / 2)).sum() / (pos.sum() * neg.sum()))


def _splits(cells: np.ndarray, shape: tuple, w: np.ndarray, s: np.ndarray, c: np.ndarray, categorical: np.ndarray, min_leaf: int):
    """Best split of each node: (gain, place among its features, left bins).

    ``cells`` (entries x features) are flat places in ``shape`` (nodes, features, bins).
    """
    size, k = int(np.prod(shape)), shape[1]
    flat = cells.ravel()
    hw, hs, hc = (np.bincount(flat, np.repeat(v, k), size).reshape(shape) for v in (w, s, c))
    order = np.broadcast_to(np.arange(shape[2]), shape)
    if categorical.any():
        # empty categories last, so that they go right
        mean = np.divide(hs, hw, out=np.full(shape, np.inf), where=hw > 0)
        order = np.where(categorical[..., None], np.argsort(mean, axis=2, kind="stable"), order)
        hw, hs, hc = (np.take_along_axis(h, order, 2) for h in (hw, hs, hc))
    lw, ls, lc = (np.cumsum(h, axis=2) for h in (hw, hs, hc))
    tw, ts, tc = lw[..., -1:], ls[..., -1:], lc[..., -1:]
    lw, ls, lc = lw[..., :-1], ls[..., :-1], lc[..., :-1]
    rw, rs = tw - lw, ts - ls
    fits = (lc >= min_leaf) & (tc - lc >= min_leaf) & (lw > 0) & (rw > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, ls * ls / lw + rs * rs / rw - ts * ts / tw, -np.inf)
    gain = gain.reshape(shape[0], -1)
    best = gain.argmax(axis=1)
    nodes = np.arange(shape[0])
    place, cut = best // (shape[2] - 1), best % (shape[2] - 1)
    left = np.zeros((shape[0], shape[2]), bool)
    np.put_along_axis(left, order[nodes, place], np.arange(shape[2])[None, :] <= cut[:, None], axis=1)
    return gain[nodes, best], place, left


def grow(rows: Rows, entry: np.ndarray, node: np.ndarray, w: np.ndarray, s: np.ndarray, c: np.ndarray, roots: int, held: np.ndarray, depth: int, min_leaf: int, cuts: list[int], pick: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Grow ``roots`` trees together, level by level.

    Entries are (row, tree) with weight, weighted response and count. Returns the responses of the
    ``held`` rows summed over the trees, for each depth of ``cuts``, and each entry's own response.
    """
    k = rows.bins.shape[1]
    rng = np.random.default_rng(seed)
    out, own = np.zeros((len(cuts), len(held))), np.zeros(len(entry))
    at = np.arange(len(entry))
    held_at, held_node = np.tile(np.arange(len(held)), roots), np.repeat(np.arange(roots), len(held))
    n = roots
    for level in range(depth + 1):
        order = np.argsort(node, kind="stable")
        at, node, entry, w, s, c = (v[order] for v in (at, node, entry, w, s, c))
        weight, total, count = (np.bincount(node, v, n) for v in (w, s, c))
        value = np.divide(total, weight, out=np.zeros(n), where=weight > 0)
        for i, cut in enumerate(cuts):
            if cut == level:
                out[i] += np.bincount(held_at, value[held_node], len(held))
        if level == depth:
            own[at] = value[node]
            break
        feature, left, grows = np.zeros(n, np.int64), np.zeros((n, BINS), bool), count >= 2 * min_leaf
        for low in range(0, n, SLICE):
            high = min(n, low + SLICE)
            a, b = np.searchsorted(node, [low, high])
            if a == b:
                grows[low:high] = False
                continue
            local = node[a:b] - low
            if pick is None:
                names = np.broadcast_to(np.arange(k), (high - low, k))
                values = rows.bins[entry[a:b]].astype(np.int64)
            else:
                names = np.argpartition(rng.random((high - low, k)), pick, axis=1)[:, :pick]
                values = rows.bins[entry[a:b][:, None], names[local]].astype(np.int64)
            m = names.shape[1]
            cells = (local[:, None] * m + np.arange(m)) * BINS + values
            gain, place, sets = _splits(cells, (high - low, m, BINS), w[a:b], s[a:b], c[a:b], rows.categorical[names], min_leaf)
            feature[low:high], left[low:high] = names[np.arange(high - low), place], sets
            grows[low:high] &= gain > 1e-12 * np.maximum(1.0, weight[low:high])
        ends = ~grows
        own[at[ends[node]]] = value[node[ends[node]]]
        gone = ends[held_node]
        if gone.any():
            done = np.bincount(held_at[gone], value[held_node[gone]], len(held))
            for i, cut in enumerate(cuts):
                if cut > level:
                    out[i] += done
            held_at, held_node = held_at[~gone], held_node[~gone]
        stay = grows[node]
        at, node, entry, w, s, c = (v[stay] for v in (at, node, entry, w, s, c))
        number = np.cumsum(grows) - 1
        node = 2 * number[node] + ~left[node, rows.bins[entry, feature[node]]]
        held_node = 2 * number[held_node] + ~left[held_node, rows.bins[held[held_at], feature[held_node]]]
        n = 2 * int(grows.sum())
        if not n:
            break
    return out, own


def forest_scores(rows: Rows, fit: np.ndarray, held: np.ndarray, depths: list[int], min_leaf: int, trees: int, seed: int) -> np.ndarray:
    """P(1) of the held rows by a forest on the rows ``fit``, for each depth."""
    k = rows.bins.shape[1]
    out, group, done = np.zeros((len(depths), len(held))), max(1, GROUP_ROWS // max(1, len(fit))), 0
    while done < trees:
        m = min(group, trees - done)
        counts = np.random.default_rng([seed, done]).poisson(1.0, (m, len(fit)))
        counts[:, 0] += counts.sum(axis=1) == 0  # a tree of no rows
        tree, place = np.nonzero(counts)
        c = counts[tree, place].astype(np.float64)
        entry = fit[place]
        w = c * rows.balanced[entry]
        some, _ = grow(rows, entry, tree, w, w * rows.label[entry], c, m, held, max(depths), min_leaf, depths, pick=int(np.ceil(np.sqrt(k))), seed=seed + 7919 * done + 1)
        out += some
        done += m
    return out / trees


def boosted_scores(rows: Rows, fit: np.ndarray, held: np.ndarray, depth: int, rate: float, rounds: int) -> np.ndarray:
    """Margins of the held rows by a boosted model on the rows ``fit``."""
    sign = 2.0 * rows.label[fit] - 1.0
    w, c = rows.boost[fit], np.ones(len(fit))
    own, out = np.zeros(len(fit)), np.zeros(len(held))
    for i in range(rounds):
        residual = sign if i == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * own))
        some, mine = grow(rows, fit, np.zeros(len(fit), np.int64), w, w * residual, c, 1, held, depth, 1, [depth])
        share = 1.0 if i == 0 else rate
        own, out = own + share * mine, out + share * some[0]
    return out


@dataclass(frozen=True)
class Job:
    """Fits of one task: a boosted point, or a forest of all depths, without one fold."""

    model: str
    fold: int
    depths: tuple[int, ...]
    min_leaf: int = 1
    rate: float = 0.0


FOUND = pa.schema([("model", pa.string()), ("depth", pa.int32()), ("min_leaf", pa.int32()), ("rate", pa.float64()), ("fold", pa.int32()), ("auc", pa.float64()), ("n_fit", pa.int64()), ("n_held", pa.int64()), ("fit_positives", pa.int64()), ("held_positives", pa.int64())])


def run_job(rows: Rows, job: Job, trees: int, rounds: int, seed: int) -> list[tuple]:
    fit, held = np.flatnonzero(rows.fold != job.fold), np.flatnonzero(rows.fold == job.fold)
    if not len(fit) or not len(held):
        scores = np.zeros((len(job.depths), len(held)))
    elif job.model == "random_forest":
        scores = forest_scores(rows, fit, held, list(job.depths), job.min_leaf, trees, seed + job.fold)
    else:
        scores = boosted_scores(rows, fit, held, job.depths[0], job.rate, rounds)[None, :]
    sizes = (len(fit), len(held), int(rows.label[fit].sum()), int(rows.label[held].sum()))
    return [(job.model, d, job.min_leaf, job.rate, job.fold, auc(rows.label[held], s), *sizes) for d, s in zip(job.depths, scores, strict=True)]


def search(spark: SparkSession, rows: Rows, jobs: list[Job], trees: int, rounds: int, seed: int) -> list:
    """A row for each (point, fold): model, depth, min_leaf, rate, fold, auc and the sizes of its parts."""
    # the costly ones first, a task each
    jobs = sorted(jobs, key=lambda j: (j.model != "boosted", -max(j.depths)))

    def run(batches):
        for part in batches:
            for i in part.column("id").to_pylist():
                found = run_job(rows, jobs[i], trees, rounds, seed)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), FOUND, strict=True)], schema=FOUND)

    schema = "model string, depth int, min_leaf int, rate double, fold int, auc double, n_fit long, n_held long, fit_positives long, held_positives long"
    return spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, schema).collect()  # a row per point and fold
