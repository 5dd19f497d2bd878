import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from retentio.llm import toxicity as X
from retentio.llm.common import settle, table
from retentio.llm.tokens import Encoder, vocabulary_path
from tests.llm.test_chosen_path import brute as groups_of
from tests.llm.test_mixing import brute as mix_of
from tests.llm.test_positions import brute as hits_of


def expected(spark, docs, sf_dir):
    """run() by plain loops over the scores of the fitted model."""
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    model = X.fit(docs, table(spark, sf_dir, "labels"))
    rows = [r for r in docs.collect() if model.score(r.text)[0] < 0.5]
    linked = groups_of([(r.doc_id, r.text) for r in rows])
    first = {doc for doc, _, _, group in linked if doc == group}
    seen, kept = set(), []
    for r in rows:
        if r.doc_id in first and r.doc_id not in seen:
            seen.add(r.doc_id)
            kept.append(r)
    hit = {doc for doc, *_, contaminated in hits_of([(r.doc_id, r.text) for r in kept], items) if contaminated}
    kept = [r for r in kept if r.doc_id not in hit]
    taken = {doc: (size, words) for doc, size, _, _, words in mix_of([(r.doc_id, r.text, r.source) for r in kept])}
    encoder, start, out = Encoder(vocabulary_path()), 0, []
    for r in sorted(kept, key=lambda r: r.doc_id):
        size, words = taken[r.doc_id]
        ids = np.array([*encoder.library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        for _ in range(words // size if size else 1):
            out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    return out


def test_run_equals_brute_force(spark, sf_dir):
    got = sorted(map(tuple, C.run(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == expected(spark, table(spark, sf_dir, "documents"), sf_dir)


def test_stages():
    assert [name for name, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]


@pytest.mark.parametrize("which", ["messy", "empty"])
def test_stages_take_messy_and_empty_tables(spark, request, sf_dir, which):
    docs = settle(request.getfixturevalue(which), "pipeline-test")
    columns = docs.columns
    for name, stage in C.STAGES:
        before = docs.count()
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-test-{name}")
        if name == "token_output":
            assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() == before
        else:
            assert docs.columns == columns
    if which == "empty":
        assert docs.count() == 0
