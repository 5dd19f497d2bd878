import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))
        own[c] = [(r[2] or "", r[3] or "") for r in mine]
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * words
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("place", "unit", "words", "depth", "digest", "tail", "row")}).repartition(4)
    made = P.trie(*P.rebuild(P.turns(df)), **options)
    return sorted((tuple(r[c] for c in COLUMNS) for r in made.collect()), key=str)


def talks(seed, n, most=6, words=3):
    r = random.Random(seed)
    texts = [" ".join(r.choice("ab cd ef".split()) for _ in range(r.randint(0, words))) for _ in range(4)]
    return [(c, t, ("user", "assistant")[t % 2], r.choice(texts)) for c in range(n) for t in range(r.randint(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = talks(seed, 120)
    assert got(spark, rows) == brute(rows)


def test_a_full_sketch_only_costs_rows(spark, monkeypatch):
    """With a sketch of eight cells nothing is proved single, and the result is the same."""
    monkeypatch.setattr(P, "MIN_WIDTH", 8)
    monkeypatch.setattr(P, "BLOCK", 8)
    rows = talks(5, 40, words=6)
    assert got(spark, rows, max_width=8) == brute(rows)


def test_sketch_never_calls_a_shared_prefix_single(spark, tmp_path):
    rows = [(k, hashlib.md5(str(k % 3000).encode()).digest()) for k in range(4000)]
    found = spark.createDataFrame(rows, "conv_id long, digest binary").repartition(7)
    root = f"file://{tmp_path}/sketch"
    P.sketch(found, P.MIN_WIDTH, root)
    asked = found.select("conv_id", F.lit(2).cast("long").alias("depth"), F.col("digest").alias("parent"))
    tails = {r.conv_id % 3000 for r in P.screen(asked, P.MIN_WIDTH, root).where("tail").collect()}
    singles = set(range(1000, 3000))
    assert tails <= singles and len(tails) > 0.99 * len(singles)


def test_nulls_ties_repeats_negative_and_turnless(spark):
    rows = [(20, 0, "user", "same words here"), (20, 1, "assistant", "yes")]
    rows += [(c, None, None, None) for c in (21, 22, 23, 24)]
    rows += [(25, 3, "user", "x"), (25, 3, "user", "x"), (25, 3, "assistant", "x"), (25, None, "user", "first")]
    rows += [(None, 0, "user", "no id"), (-3, 0, "user", "a b"), (-25, 0, "user", "a b"), (-20, 0, "user", "z"), (0, 0, "user", "q r s")]
    rows += [(c, t, "user", "t" * t) for c in (1, 2, 7) for t in range(3)] + [(9_000_000_000_001, 0, "user", "far"), (39, 0, "user", "no base"), (61, 0, "user", "w")]
    found = got(spark, rows)
    assert found == brute(rows)
    assert [r for r in found if r[1] == 0][0][3] == len({r[0] for r in rows if r[0] is not None})


def test_one_hot_conversation_over_many_tasks(spark):
    """A conversation with most of the turns, and its copies, are dealt to several tasks and carried over."""
    rows = [(c, t, "user", f"turn {t % 7}") for c in (100, 140, 160) for t in range(300)] + talks(3, 15)
    assert got(spark, rows) == brute(rows)


def test_running_sums_are_carried(spark):
    rows = spark.range(0, 2000).select((F.col("id") % 3 == 0).cast("long").alias("conv_id"), F.col("id").alias("place"), F.lit(2).cast("long").alias("v"))
    for r in P.running(rows, ["place"], ["v"], "test").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("run_v").alias("top"), F.countDistinct("run_v").alias("all")).collect():
        assert r.top == 2 * r.n and r["all"] == r.n


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 7)
    members = spark.range(0, 500).select(F.lit(b"n").alias("digest"), (F.col("id") * 3 - 100).alias("conv_id")).repartition(5)
    want = hashlib.sha256(",".join(str(3 * i - 100) for i in range(500)).encode()).hexdigest()
    assert [r.ends_sha256 for r in P.ends(members).collect()] == [want]


def test_empty_and_turnless_tables(spark):
    assert got(spark, []) == []
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "user", "goes")]  # its first turn is replaced, and there is no base
    assert got(spark, rows) == brute(rows) and len(brute(rows)) == 1
