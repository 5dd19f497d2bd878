import hashlib
import re

import numpy as np
import pytest

from retentio.llm import positions as P
from tests.llm.conftest import messy_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for at in range(len(w) - size + 1):
                if own := windows.get(tuple(w[at : at + size])):
                    hit.update(range(at, at + size))
                    found |= own
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, prose(1, 30)), (2, "One"), (3, None), (4, ""), (5, prose(1, 80)), (6, prose(8, 40)), (None, prose(12, 12)), (7, "Spam spam SPAM spam"), (7, "日本 日本 日本"), (10, prose(11, 400).upper())]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(df):
    return sorted(map(tuple, df.drop("item_ids", "text_md5").collect()), key=repr)


def test_equals_brute_force(messy, items):
    assert found(P.contamination(messy, items)) == brute([(r[0], r[1]) for r in messy_rows()], ITEMS)


def test_blocks_of_items_and_small_segments_change_nothing(messy, items, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_WORDS", 60)
    monkeypatch.setattr(P, "SEGMENT_BYTES", 500)
    assert found(P.contamination(messy, items)) == brute([(r[0], r[1]) for r in messy_rows()], ITEMS)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c x d e"), (2, "a b c d e"), (3, "a b x y z c d e"), (4, "e d c b a")], "doc_id long, text string")
    item = spark.createDataFrame([(9, "a b c d e")], "item_id long, text string")
    index = P.build_index(docs)
    hits = lambda slop: {r.doc_id for r in P.search(index, item, slop=slop).where("size(matches) > 0").collect()}
    assert hits(0) == {2}
    assert hits(1) == {1, 2}
    assert hits(3) == {1, 2, 3}
    with pytest.raises(ValueError):
        P.search(index, item, slop=60)


def test_stored_postings_give_the_text_back(spark, messy):
    import zstandard

    texts = {}
    for seg in P.build_index(messy, segment_bytes=2000).collect():
        flat = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(seg.postings)), "<i4"))
        term_at = dict(zip(flat.tolist(), (t for t, n in zip(seg.terms, seg.counts, strict=True) for _ in range(n)), strict=True))
        at = 0
        for doc, digest, n in zip(seg.doc_ids, seg.digests, seg.lengths, strict=True):
            texts.setdefault((doc, bytes(digest)), [bytes(term_at[k]).decode() for k in range(at, at + n)])
            at += n + P.GAP
    for doc, text, *_ in messy_rows():
        assert texts[doc, hashlib.md5((text or "").encode()).digest()] == words(text)


def test_empty(messy, empty, items):
    assert P.contamination(empty, items).collect() == []
    clean = P.contamination(messy, items.where("false"))
    assert clean.count() == len(messy_rows()) and clean.where("contaminated or n_hit > 0 or n_items > 0").count() == 0
