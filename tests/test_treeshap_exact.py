"""Tree attributions against all subsets of features, on hand-written trees."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from retentio.ml.treeshap import _leaf_paths, tree_shap, tree_shap_batch


def _tree(scale=1.0):
    """Depth 3, a feature used twice on a path, one categorical split."""
    left = np.array([1, 3, 5, -1, 7, -1, -1, -1, -1])
    right = np.array([2, 4, 6, -1, 8, -1, -1, -1, -1])
    feat = np.array([0, 1, 2, -1, 0, -1, -1, -1, -1])
    thr = np.array([0.5, 2.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0])
    cats = [None, None, frozenset({1.0, 3.0}), None, None, None, None, None, None]
    value = np.array([0.0, 0.0, 0.0, 4.0, 0.0, -2.0, 7.0, 1.5, -3.0])
    cover = np.array([100.0, 60.0, 40.0, 45.0, 15.0, 10.0, 30.0, 5.0, 10.0])
    return left, right, feat, thr, cats, value, cover, scale


def _given(tree, x, known, node=0):
    """Expected output when only ``known`` features are fixed; others follow the training cover."""
    left, right, feat, thr, cats, value, cover, scale = tree
    if left[node] < 0:
        return value[node] * scale
    f = feat[node]
    if f in known:
        goes = float(x[f]) in cats[node] if cats[node] is not None else x[f] <= thr[node]
        return _given(tree, x, known, left[node] if goes else right[node])
    a, b = cover[left[node]] / cover[node], cover[right[node]] / cover[node]
    return a * _given(tree, x, known, left[node]) + b * _given(tree, x, known, right[node])


def _shapley(tree, x, n):
    out = np.zeros(n)
    for f in range(n):
        rest = [k for k in range(n) if k != f]
        for size in range(n):
            weight = factorial(size) * factorial(n - size - 1) / factorial(n)
            for s in combinations(rest, size):
                out[f] += weight * (_given(tree, x, {*s, f}) - _given(tree, x, set(s)))
    return out


@pytest.mark.parametrize("scale", [1.0, 0.25])
def test_equals_all_subsets(scale):
    tree = _tree(scale)
    rows = np.array([[a, b, c] for a in (-2.0, 0.0, 0.5, 0.6) for b in (1.0, 2.5) for c in (0.0, 1.0, 3.0)])
    want = np.array([_shapley(tree, x, 3) for x in rows])
    one = np.zeros_like(rows)
    for i, x in enumerate(rows):
        tree_shap(x, tree, one[i])
    many = np.zeros_like(rows)
    tree_shap_batch(rows, tree, many, _leaf_paths(tree), {})
    assert np.allclose(one, want, atol=1e-12)
    assert np.allclose(many, want, atol=1e-12)
