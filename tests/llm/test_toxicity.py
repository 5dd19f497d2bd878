import math
import random
import zlib

import numpy as np
import pytest

from retentio.llm import toxicity as X
from tests.llm.conftest import WORDS, prose


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = prose(i, 60)
        if toxic:
            text += " " + " ".join(random.Random(i).choice(("nasty", "vile", "grimly", "grimble")) for _ in range(3))
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return X.fit(*labelled)


def cut(text):
    """Terms by a rule of its own: runs of letters, their first four."""
    out, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            out.append(run[:4])
            run = ""
    return out


@pytest.fixture(scope="module")
def plain(labelled, model):
    """TF-IDF vectors of the examples, made apart from the operator."""
    texts = {r.doc_id: r.text for r in labelled[0].collect()}
    ids = model.index().ids.tolist()
    known = {t for d in ids for t in cut(texts[d])}
    df = {t: 0 for t in known}
    for text in texts.values():
        for t in set(cut(text)) & known:
            df[t] += 1

    def vector(text):
        words = [t for t in cut(text) if t in known]
        w = {t: (1 + math.log(words.count(t))) * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for t in set(words)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    return {d: vector(texts[d]) for d in ids}, vector


def found(index, texts, k, skips=None):
    ends, at, n = X.counted(index.terms, texts)
    vectors = [(at[a:b], index.vector(at[a:b], n[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return vectors, index.nearest(vectors, k, skips)


@pytest.mark.parametrize("k", [1, 15, 100, 5000])
def test_neighbours_are_exact(model, plain, k):
    """Block-max search equals the plain TF-IDF cosine with every example; equal cosines go by id."""
    vectors, vector = plain
    index = model.index()
    texts = [f"vile nasty {w}" for w in WORDS] + ["grimmest nasty nasty vile", "grimly", "", None, "unknown"] + [prose(900 + i, 7 * i) for i in range(12)]
    for text, (i, s, _) in zip(texts, found(index, texts, k)[1], strict=True):
        own = vector(text)
        cosines = {d: sum(x * own.get(t, 0) for t, x in v.items()) for d, v in vectors.items()}
        order = sorted((d for d in cosines if cosines[d] > 0), key=lambda d: (-round(cosines[d], 9), d))[:k]
        assert len(order) == len(i) and np.allclose(s, [cosines[d] for d in order])
        assert sorted(zip(-np.round(s, 9), index.ids[i], strict=True)) == sorted((-round(cosines[d], 9), d) for d in order)


def test_equal_cosines_go_by_id_not_by_label(spark):
    docs = spark.createDataFrame([(i, f"same words here {'x' * (i % 2)} {i}") for i in range(1, 60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 60)], "doc_id long, toxic int")
    index = X.fit(docs.withColumn("text", X.F.concat_ws(" ", "text", X.F.when(X.F.col("doc_id") % 3 == 0, "bad").otherwise("good"), X.F.format_string("%c%c", (97 + X.F.col("doc_id") % 26).cast("int"), (97 + X.F.col("doc_id") / 26).cast("int")))), marks).index()
    i, s, _ = found(index, ["same words"], 200)[1][0]
    for a, b in zip(range(len(i)), range(1, len(i)), strict=False):
        assert (-s[a], index.ids[i[a]]) < (-s[b], index.ids[i[b]])


def test_blocks_are_skipped(spark):
    """Examples of other kinds are not read: their blocks are bounded below the nearest."""
    rows, marks = [], []
    for i in range(1200):
        r = random.Random(i)
        kind = "abcd"[i % 4]
        rows.append((i, " ".join(kind + r.choice("efghijklmnop") + r.choice("efghijklmnop") for _ in range(60)) + " same"))
        marks.append((i, int(i % 8 < 4)))
    index = X.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).index()
    assert index.blocks > 10
    vectors, nearest = found(index, [t for _, t in rows[:40]], 10)
    _, read = index.sums(vectors, 10)
    assert 0 < read.sum(1).max() < index.blocks and read.mean() < 0.7
    kinds = {d: t[0] for d, t in rows}
    for (d, t), (i, _, _) in zip(rows[:40], nearest, strict=True):
        assert {kinds[x] for x in index.ids[i].tolist()} == {t[0]}


def test_driver_holds_only_numbers(model):
    import pickle

    assert set(vars(model)) == {"root", "share", "curve"} and len(pickle.dumps(vars(model))) < 1000


def test_all_terms_of_the_examples_count(spark):
    """Rare words and few labels: a near copy of an example finds it."""
    rows, labels = [], []
    for i in range(24):
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(30))))
        labels.append((i, int(i % 3 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    small = X.fit(docs, marks)
    for d, text in rows:
        if d in small.index().ids:
            score, evidence = small.score("Other " + text.rsplit(" ", 3)[0])
            assert evidence[0][0] == d and evidence[0][1] > 0.9
    assert len({small.score(t)[0] for _, t in rows}) > 1


def test_counts_of_many_texts_are_those_of_each(model):
    index = model.index()
    names = sorted(index.terms, key=index.terms.get)
    texts = [prose(i, 5 * i) for i in range(30)] + ["", None, "vile grimly grimble grim unknown", "grimly " * 9, "été_x 3a b4c ÉTÉ"]
    ends, at, k = X.counted(index.terms, texts)
    for j, text in enumerate(texts):
        got = {names[i]: n for i, n in zip(at[ends[j] : ends[j + 1]].tolist(), k[ends[j] : ends[j + 1]].tolist(), strict=True)}
        assert got == {t: cut(text).count(t) for t in cut(text) if t in index.terms}
        assert X.terms_of(text) == {t: cut(text).count(t) for t in cut(text)}


def test_a_hot_id_is_one_example(spark):
    """An id with very many texts gives one of them; without it the sample would not be bounded."""
    docs = spark.createDataFrame([(1, f"word{chr(97 + i % 26)} " * 3 + str(i)) for i in range(300)] + [(i, prose(i, 20)) for i in range(2, 40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    ids = X.fit(docs, marks).index().ids.tolist()
    assert len(ids) == len(set(ids)) <= 39


def test_unseen_inflections_and_clean_texts(model):
    assert model.score("a grimness of " + prose(7, 50) + " grimful grimmer")[0] > 0.5
    assert model.score(prose(3, 50))[0] < 0.5
    score, evidence = model.score("vile nasty " + prose(4, 30))
    assert score > 0.5 and evidence and all(y == 1 for _, _, y in evidence[:3])


def test_scores_are_calibrated(labelled, model):
    docs, labels = labelled
    rows = X.score(docs, model).join(labels, "doc_id").select("doc_id", "toxicity.score", "toxic").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 60
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in held) / len(held) > 0.97
    assert abs(sum(r.score for r in held) / len(held) - sum(r.toxic for r in held) / len(held)) < 0.06


def test_held_out_accuracy_on_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in X.op2_toxicity(spark, sf).collect()]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_labels_of_the_held_out_fold_are_not_used(labelled, model):
    docs, labels = labelled
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(X.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = X.fit(docs, flipped)
    ids = model.index().ids.tolist()
    terms, curve = model.index().terms, model.curve
    assert other.curve == curve and other.index().terms == terms and other.index().ids.tolist() == ids
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_messy_rows(spark, messy, empty, labelled, model):
    got = X.score(messy, model)
    assert got.count() == messy.count()
    assert set(messy.columns) == set(got.columns)  # the clashing name is replaced by the scores
    blank = {r.score for r in got.where("text is null or trim(text) = ''").select("toxicity.score").collect()}
    assert len(blank) == 1 and not math.isnan(blank.pop())
    assert X.score(empty, model).collect() == []
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (7, 0)], "doc_id long, toxic int")
    assert {r.s for r in X.score(messy, X.fit(messy, odd)).select("toxicity.score").toDF("s").collect()}
    assert X.fit(empty, labelled[1]).score("vile")[0] >= 0
    assert X.fit(messy, odd.where("false")).score("vile") == (0.0, [])


def test_labelled_texts_without_a_word(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " 12 "), (4, "--"), (6, "..")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 6)], "doc_id long, toxic int")
    model = X.fit(docs, marks)
    scores = {model.score(t)[0] for t in ("", None, "vile words", " 12 ")}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_terms_are_sought_once_in_each_distinct_word(monkeypatch):
    r, asked = random.Random(4), []
    texts = [None, "", "  \n", *("".join(r.choices("abABßÉσΣςİıǅ'_1 \n\t.", k=r.randint(0, 40))) for _ in range(500))]
    want = [X.terms_of(t) for t in texts]
    terms = {t: i for i, t in enumerate(sorted({t for w in want[:400] for t in w}))}
    names = list(terms)
    pattern = X.TERM

    class Seen:
        def findall(self, text):
            asked.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(X, "TERM", Seen())
    ends, at, k = X.counted(terms, texts)
    assert [{names[a]: int(n) for a, n in zip(at[i:j], k[i:j], strict=True)} for i, j in zip(ends[:-1], ends[1:], strict=True)] == [{t: n for t, n in w.items() if t in terms} for w in want]
    asked.clear()
    X.counted(terms, ["Abab σa abab! abab\nσa"] * 50)
    assert asked == ["σa"]
