import hashlib
import re

import pytest
from pyspark.sql import functions as F

from retentio.llm import mixing as M
from tests.llm.conftest import messy_rows


def brute_targets(sizes):
    """Shares by weight; what a cap cuts off is shared again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows):
    sizes, out = {}, []
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    target = brute_targets(sizes)
    key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:12]
    for source, total in sizes.items():
        own = [r for r in rows if r[2] == source]
        whole = int(target[source] // total) if total else 0
        rest, end = target[source] - whole * total, 0
        groups = {}
        for r in own:
            groups.setdefault(key(r), []).append(r)
        for k in sorted(groups):
            # of equal rows as many as come nearest
            for i, r in enumerate(groups[k]):
                more = end + size(r[1]) <= rest + 1e-9 or (end <= rest and 2 * (rest - end) >= size(r[1]))
                end += size(r[1])
                out.append((r[0], size(r[1]), total, target[source], size(r[1]) * min(3, whole + more)))
    return sorted(out, key=repr)


def compare(got, want):
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[4] == w[4] and g[3] == pytest.approx(w[3])


def test_equals_brute_force(messy):
    got = M.mix(messy).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))
    compare(sorted(map(tuple, got.collect()), key=repr), brute([(r[0], r[1], r[3]) for r in messy_rows()]))


@pytest.mark.parametrize("ids", [1, 3])
def test_repeated_rows_reach_the_target(spark, ids):
    """Rows equal in doc_id and text: as many are taken as come nearest to the target, over several tasks."""
    rows = [(i % ids, f"w{i % ids} " * 10, "a", i) for i in range(400)] + [(1000 + i, "w " * 10, "b", i) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(7)
    got = M.mix(docs).collect()
    assert sorted((r.doc_id, r.extra) for r in got) == sorted((r[0], r[3]) for r in rows)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.mix.size * r.mix.copies
        target[r.source] = r.mix.target
        assert r.mix.copies <= 3
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)


def test_water_level(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 0, "e": 500, "f": 7, None: 20}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = {r.source: r.mix.target for r in M.mix(docs).collect()}
    want = brute_targets(sizes)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_taken_is_near_the_target(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    rows = M.op8_mix_sources(spark, sf).collect()
    by = {}
    for r in rows:
        t = by.setdefault(docs[r.doc_id].source, [0, r.target, 0])
        t[0] += r.taken
        t[2] = max(t[2], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken - target) <= largest / 2 + 1 for taken, target, largest in by.values())


def test_take_repeats_documents(messy, empty):
    mixed = {(r.doc_id, r.text): r.mix.copies for r in M.mix(messy.where("doc_id <> 10")).collect()}
    taken = M.take(messy.where("doc_id <> 10"))
    assert taken.columns == messy.columns
    counts = {}
    for r in taken.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    assert counts == {k: n for k, n in mixed.items() if n}
    assert M.take(empty).collect() == [] and M.mix(empty).collect() == []
