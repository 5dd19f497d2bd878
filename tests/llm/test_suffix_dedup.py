import hashlib
from collections import Counter

import numpy as np
import pytest

from retentio.llm import suffix_dedup as S
from tests.llm.conftest import messy_rows


def brute(rows, length=200, keep="none"):
    rows = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1]).digest()))
    texts = Counter(b for _, b in rows)
    counts = Counter(b[s : s + length] for b in texts for s in range(len(b) - length + 1) for _ in range(texts[b]))
    first_id, seen, out = {}, set(), []
    for i, b in rows:
        first_id.setdefault(b, i)
    done = {}
    for i, b in rows:
        hit = bytearray(len(b))
        if keep == "first" and i != first_id[b]:
            hit = bytearray([len(b) >= length] * len(b))
        elif keep == "first" and b in done:
            hit = done[b]
        else:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                if counts[w] > 1 if keep == "none" else w in seen:
                    hit[s : s + length] = b"\1" * length
                seen.add(w)
            done[b] = hit
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        runs = sum(1 for j in range(len(hit)) if hit[j] and (j == 0 or not hit[j - 1]))
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    rows = S.deduplicate(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("length", [1, 5, 8, 9, 20])
def test_suffix_ranks_are_the_order_of_windows(length):
    data = np.random.default_rng(length).integers(1, 4, 300).astype(np.uint8)
    windows = [bytes(data[i : i + length]).ljust(length, b"\0") for i in range(300)]
    order = {w: k for k, w in enumerate(sorted(set(windows)))}
    assert np.unique(S.suffix_ranks(data, length), return_inverse=True)[1].tolist() == [order[w] for w in windows]


def test_smaller_neighbours():
    p = np.random.default_rng(3).permutation(300)
    before, after = S.smaller_neighbours(p)
    for i in range(300):
        assert before[i] == max((j for j in range(i) if p[j] < p[i]), default=-1)
        assert after[i] == min((j for j in range(i + 1, 300) if p[j] < p[i]), default=300)


def test_equal_windows_have_equal_anchors():
    a = np.frombuffer((b"some text before " * 9 + bytes(range(256)) * 2), np.uint8)
    b = np.frombuffer((b"other " * 40 + bytes(range(256)) * 2 + b" behind"), np.uint8)
    names = []
    for data in (a, b):
        own = {}
        for start, n, offset, anchor in S.window_runs(data):
            for k in range(n):
                own.setdefault(bytes(data[start + k : start + k + 200]), set()).add((offset - k, int(anchor)))
        names.append(own)
    shared = names[0].keys() & names[1].keys()
    assert len(shared) >= 256
    assert all(names[0][w] & names[1][w] for w in shared)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [1024, 1])
def test_equals_brute_force(spark, messy, sf_dir, monkeypatch, keep, hot):
    monkeypatch.setattr(S, "HOT", hot)  # with 1, every anchor is dealt in parts
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(docs, keep=keep) == brute([(r.doc_id, r.text) for r in docs.collect()], keep=keep)
    assert found(messy, keep=keep) == brute([(r[0], r[1]) for r in messy_rows()], keep=keep)


@pytest.mark.parametrize("step", [16, 7, 1])
def test_equal_windows_have_equal_cores(step):
    passage = bytes(np.random.default_rng(5).integers(97, 123, 400).astype(np.uint8))
    named: list[dict] = []
    for raw in (b"left one " * 20 + passage + b" right", passage[30:] + b" other end" * 20):
        own = {}
        for start, n, offset, _ in S.window_runs(np.frombuffer(raw, np.uint8)):
            cut = raw[start : start + n + 199]
            slices = S.run_slices(cut, n, offset, step)
            assert [a for a, *_ in slices] + [n] == [0] + [b for _, b, *_ in slices]
            for a, b, core, far in slices:
                for w in range(a, b):
                    assert len(core) == 201 - step and core in cut[w : w + 200]
                    own.setdefault(cut[w : w + 200], set()).add((core, far // step))
        named.append(own)
    shared = named[0].keys() & named[1].keys()
    assert len(shared) >= 171
    assert all(named[0][w] & named[1][w] for w in shared)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_anchors_send_few_rows(spark, monkeypatch, keep):
    """A passage in many texts, its edges all different, some edges shared by few: rows by run, not by window."""
    monkeypatch.setattr(S, "HOT", 8)
    made, settle = {}, S.settle

    def counted(df, name):
        out = settle(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(S, "settle", counted)
    r = np.random.default_rng(9)
    own = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8)).decode()
    passage, edges = own(700), [own(150) for _ in range(3)]
    texts = [own(150) + passage + own(150) for _ in range(60)] + [own(60) + edges[i % 3] + passage[: 300 + 40 * i] + own(120) for i in range(9)]
    texts += [passage[100:420] + passage[100:420], passage, None, "", texts[0], passage[200:401]]
    rows = [(i % 70 if i else None, t) for i, t in enumerate(texts)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(docs, keep=keep) == brute(rows, keep=keep)
    assert made["hot-anchors"] >= 2
    # before, every distinct window of a part went on: 7,712 rows
    assert sum(made.get(n, 0) for n in ("repeats", "slices", "slice-repeats")) <= 5000


def test_registered_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = S.op1_suffix_dedup(spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs])


def test_spans_and_kept_bytes_agree(messy):
    for r in S.deduplicate(messy).collect():
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_removed == r.n_bytes - len(r.kept)
        assert len(r.spans) == r.n_spans


def test_empty(empty):
    assert S.deduplicate(empty).collect() == []
