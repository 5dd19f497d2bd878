import random

import numpy as np

from retentio.llm import chosen_path as J
from tests.llm.conftest import messy_rows, prose


def sets_of(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    small = lambda ids: min((i for i in ids if i is not None), default=None)
    links = [[b for b in range(len(sets)) if b != a and near(sets[a][1], sets[b][1])] for a in range(len(sets))]
    out = []
    for a in range(len(sets)):
        group, todo = {a}, [a]
        while todo:
            new = set(links[todo.pop()]) - group
            group |= new
            todo += new
        out.append((sets[a][0], small(i for i, s in sets if s == sets[a][1]), len(links[a]), small(sets[b][0] for b in group)))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, J.jaccard_join(df).select("doc_id", "class_id", "n_links", "group_id").collect()), key=repr)


def near_copies(n, words=120, seed=0):
    r = random.Random(seed)
    base = prose(seed, words).split()
    for i in range(n):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = f"changed{i}x{r.random()}"
        yield " ".join(own)


def test_equals_brute_force_on_messy_rows(messy):
    assert found(messy) == brute([(r[0], r[1]) for r in messy_rows()])


def test_equals_brute_force_on_large_groups(spark, monkeypatch):
    """Nodes dealt in parts, components dealt as pairs of parts; pairs just at 0.8; passages below it."""
    monkeypatch.setattr(J, "SMALL", 16)
    monkeypatch.setattr(J, "PART", 24)
    texts = [*near_copies(150, seed=1), *near_copies(40, seed=2), *(prose(3, 60) + " " + prose(100 + i, 60) for i in range(60)), *near_copies(30, 40, seed=4)]
    texts += texts[:20] + ["Upper CASE of the same words here"] + ["upper case OF the same words here"] * 2
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs) == brute(rows)


def test_a_group_of_near_copies_is_not_carried_from_level_to_level(spark, monkeypatch):
    """Linked sets end where they are found; a few that only resemble some of them are still linked."""
    monkeypatch.setattr(J, "SMALL", 16)
    made, settle = {}, J.settle

    def counted(df, name):
        out = settle(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(J, "settle", counted)
    texts = list(near_copies(200, seed=11))
    # 0.8 from an edge of the group: of the words of a copy, some at the end are others
    texts += [" ".join([*texts[i].split()[: 120 - 13], *prose(700 + i, 13).split()]) for i in range(6)]
    texts += [prose(800 + i, 60) for i in range(40)]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
    start = J.runs_needed() * J.BRANCHES * len(texts)
    assert sum(made["full-nodes"]) <= 1.5 * start and sum(made["paths"]) <= 2 * start


def test_runs_reach_the_target_recall():
    """Simulated: pairs of just 0.8 meet in at least the target share."""
    assert J.runs_needed() == 4
    r = random.Random(1)

    def meet(depth):
        return depth == 0 or any(r.random() < 0.64 and meet(depth - 1) for _ in range(J.BRANCHES))

    assert sum(not any(meet(J.DEPTH) for _ in range(J.runs_needed())) for _ in range(20_000)) <= 8


def test_sketches_estimate_jaccard():
    a, b = prose(5, 400), prose(5, 360) + " " + prose(6, 40)
    x, y = J.shingles(a), J.shingles(b)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((J.sketch(x) == J.sketch(y)).mean() - true) < 0.12
    assert (J.sketch(x) == J.sketch(x)).all()


def test_recall_on_the_documents_against_brute_force(spark):
    """All links of at least 0.8 among all documents are found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)


def test_one_document_of_each_group(messy, empty):
    first = J.first_of_groups(messy)
    assert first.columns == messy.columns
    groups = {g for *_, g in brute([(r[0], r[1]) for r in messy_rows()])}
    ids = sorted((r.doc_id for r in first.select("doc_id").collect()), key=repr)
    assert set(ids) == groups
    assert len(ids) == len(groups) + 1  # two groups have no id
    assert J.first_of_groups(empty).collect() == [] and J.jaccard_join(empty).collect() == []


def test_null_and_repeated_ids_are_no_key(spark):
    """Texts are found by their digest: rows without an id, or all of one id, meet their own class only."""
    texts = [*near_copies(60, seed=7), *(prose(500 + i, 30) for i in range(60))] * 2
    for ids in ([None] * 240, [5] * 240):
        rows = list(zip(ids, texts, strict=True))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert found(docs) == brute(rows)
