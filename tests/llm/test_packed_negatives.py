import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import packed_negatives as P
from retentio.llm.packed_negatives import Best, Packed, hard_negatives, keys_of, packing, window

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, negatives=3, share=(50, 95), scale=256):
    """All products in Python integers."""
    usable = [(i, [int(np.floor(scale * x)) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, seen = [], set()
    for i, v, c in usable:
        if i is None or i % every or (i, tuple(v), c) in seen:
            continue
        seen.add((i, tuple(v), c))
        others = [(dot(v, w), j, d) for j, w, d in usable if j != i]
        near = sorted((o for o in others if o[2] == c), key=lambda o: (-o[0], name(o[1])))[:positives]
        for s, j, _ in near:
            far = sorted((o for o in others if o[2] != c and share[0] * s <= 100 * o[0] <= share[1] * s), key=lambda o: (-o[0], name(o[1])))
            out += [(i, j, k + 1, o[1], s, o[0]) for k, o in enumerate(far[:negatives])]
    return sorted(out, key=str)


def got(df):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def vectors(seed, n, d, labels=3, spread=1.0):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.normal(size=d) * spread + 0.3], int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("low", "high", "d"), [(-130, 130, 64), (0, 0, 3), (-3, 900_000, 7), (-(1 << 25), 1 << 25, 40), (-1, 1, 1)])
def test_packed_products_are_exact(low, high, d):
    r = np.random.default_rng(1)
    q = r.integers(low, high + 1, (37, d))
    a = r.integers(low, high + 1, (5, d))
    q[0], a[0] = high, high  # the largest sums
    q[1], a[1] = low, low
    packed = Packed(q, min(low, 0), max(high, 0))
    assert packed.short == (packing(min(low, 0), max(high, 0), d)[0] <= P.EXACT_BITS)
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in q] for u in a]
    assert packed.scores(a).tolist() == want


def test_several_candidates_share_a_wide_integer():
    assert packing(-130, 130, 64)[1] == 2 and packing(0, 15, 16)[1] == 4
    assert packing(-(1 << 25), 1 << 25, 40)[2] is False


def test_bounds_of_the_window():
    for s in range(-250, 251):
        low, high = (int(v[0]) for v in window(np.array([s]), 50, 95))
        inside = [t for t in range(-260, 261) if 50 * s <= 100 * t <= 95 * s]
        assert [t for t in range(-260, 261) if low <= t <= high] == inside
    low, high = window(np.array([1 << 61]), 50, 95)
    assert (int(low[0]), int(high[0])) == (1 << 60, (95 << 61) // 100)


def test_best_keeps_ties_by_id_over_batches():
    r = random.Random(3)
    best, every = Best(2, 4), defaultdict(list)
    for _ in range(30):
        ids = np.array(sorted(r.sample(range(1000), 5)))
        scores = np.array([[r.randint(0, 3) for _ in ids] for _ in range(2)])
        allowed = np.array([[r.random() < 0.7 for _ in ids] for _ in range(2)])
        best.add(np.arange(2), scores, keys_of(scores), ids, allowed)
        for row in range(2):
            every[row] += [(-int(s), int(i)) for s, i, ok in zip(scores[row], ids, allowed[row]) if ok]
    for row in range(2):
        assert [(-int(s), int(i)) for s, i in zip(best.scores[row], best.ids[row])] == sorted(every[row])[:4]


def test_keys_of_wide_scores():
    scores = np.array([[1 << 61, -(1 << 61), 1 << 61]])
    assert np.argsort(-keys_of(scores)[0]).tolist() == [0, 2, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(P, "BLOCK", 32)
    monkeypatch.setattr(P, "ANCHORS", 4)
    rows = vectors(seed, 400, 6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(hard_negatives(df, every=20)) == brute(rows, every=20)


def test_nulls_ties_repeats_and_lengths(spark):
    same = [0.5, 0.25, -0.125]
    rows = [(i, same, 0) for i in range(0, 60)]  # all scores equal
    rows += [(100 + i, [0.3, 0.2, 0.0], 1) for i in range(6)] + [(100, [0.3, 0.2, 0.0], 1)]
    rows += [(50, same, 0), (None, same, 0), (None, [0.3, 0.2, 0.0], 1), (7, None, 1), (8, same, None)]
    rows += [(9, [0.1, None, 0.2], 1), (10, [float("nan"), 0.1, 0.1], 1), (11, [float("inf"), 0.1, 0.1], 1)]
    rows += [(150, [0.5], 2), (151, [], 2), (152, [0.4, 0.3, 0.2, 0.1], 2), (-50, [0.5, 0.2, 0.1], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "q", "a", "p", "score", "best")}).repartition(4)
    found = got(hard_negatives(df))
    assert found == brute(rows)
    assert {r[0] for r in found} >= {0, 50, 100}


def test_one_hot_vector_and_large_components(spark):
    rows = [(i, [1.0, 1.0], 0 if i % 3 else 1) for i in range(300)] + [(1000 + i, [1e6 + i, -2e6], 2) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(hard_negatives(df)) == brute(rows)


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e18], 1), (1, [1e18], 1)], SCHEMA)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives(df)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, [0.1], 1)], SCHEMA)).count() == 0  # no anchor
    assert hard_negatives(spark.createDataFrame([(0, [0.1], 1)], SCHEMA)).count() == 0  # no other row
    assert hard_negatives(spark.createDataFrame([(0, None, 1)], SCHEMA)).columns[0] == "anchor_id"
