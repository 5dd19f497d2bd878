import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retentio.llm import tokens as T
from retentio.llm.common import filesystem, kept, output_root
from tests.llm.conftest import messy_rows

ENCODER = T.Encoder(T.vocabulary_path())


def library(text):
    return ENCODER.library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sStré日1²_ \n\t  .!<|>​\r")), max_size=40) | st.text(max_size=20))
def test_encoder_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODER.ids(text) == np.array(library(text), ENCODER.dtype).tobytes()


def test_special_strings_equal_the_library():
    for text in ("a <|endoftext|> b", "<|endoftext|>", "we'll they've it's I'm\nthat's 12 3rd x_y", "a\nb", "a b\nc d.\nE"):
        assert ENCODER.ids(text) == np.array(library(text), ENCODER.dtype).tobytes()


def test_cache_bounds(monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 5)
    monkeypatch.setattr(T, "CACHE_KEPT", 2)
    r, own = random.Random(1), T.Encoder(T.vocabulary_path())
    for _ in range(30):
        text = " ".join("".join(r.choices("abcdef", k=5)) + r.choice(("", ",", ".\nx")) for _ in range(9)) + " " + "y" * 60
        assert own.ids(text) == np.array(library(text), own.dtype).tobytes()


def test_many_texts_equal_the_library(monkeypatch):
    r = random.Random(5)
    words = ["it's", "a", "Hello,", "wörld!!", "<|endoftext|>", "é" * 45 + ",", "don't", "\n", "ok.\nNow", "end...'", "'s", "s'", "ab1.", "×a", "ªb.", "中", "y" * 60, "", "\t"]
    texts = ["", "\n", " a", "a\n", *(" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(600))]
    for size in (200, 1 << 20):
        monkeypatch.setattr(T, "TOGETHER_BYTES", size)
        own = T.Encoder(T.vocabulary_path())
        assert list(own.encode(pa.array(texts))) == [np.array(library(t), own.dtype).tobytes() for t in texts]


def test_words_of_the_same_letters_are_encoded_once(monkeypatch):
    own, asked = T.Encoder(T.vocabulary_path()), []
    given = own._encode_letters
    monkeypatch.setattr(own, "_encode_letters", lambda words: given(asked.extend(words) or words))
    texts = ["qaze wsxe, qaze.", "wsxe qaze! (qaze", "wsxe... qaze,\nqaze"]
    for _ in range(2):
        assert list(own.encode(pa.array(texts))) == [np.array(library(t), own.dtype).tobytes() for t in texts]
    assert sorted(asked) == ["qaze", "wsxe"]


def test_a_worker_keeps_one_thing_of_all_operators():
    first = T.encoder(T.vocabulary_path())
    assert T.encoder(T.vocabulary_path()) is first
    assert kept("of-another-operator", list) == []
    assert T.encoder(T.vocabulary_path()) is not first


def expected(rows):
    start, out = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.array([*library(r[1]), 2], "<u2").tobytes())):
        ids = [*library(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, messy):
    root = output_root(spark, "tokens-test")
    files = T.write_tokens(messy, root, T.vocabulary_path(), shard_bytes=20_000)
    assert len(files) == 3
    rows = sorted(T.read_tokens(spark, root).collect(), key=lambda r: r.start)
    want = expected(messy_rows())
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == want
    assert all(r.ids == [*r.ids[:-1], 2] and len(r.ids) == r.n_tokens for r in rows)
    # shuffled reads through the offset index
    for r in random.Random(2).sample(rows, 8):
        doc_id, ids = T.read_record(root, r.file, r.record)
        assert doc_id == r.doc_id and ids.tolist() == r.ids


def test_query(spark, sf_dir):
    got = sorted(map(tuple, T.op9_token_records(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == expected([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_same_bytes_whatever_the_partitions(spark, messy):
    files = [T.write_tokens(messy.repartition(n), output_root(spark, "tokens-test"), T.vocabulary_path(), shard_bytes=20_000) for n in (1, 5)]
    assert files[0] == files[1]


def test_damage_is_found(spark, messy):
    root = output_root(spark, "tokens-test")
    files = T.write_tokens(messy, root, T.vocabulary_path())
    fs, folder = filesystem(root)
    path = f"{folder}/{files[0]['name']}.bin"
    with fs.open_input_stream(path) as f:
        data = bytearray(f.read())
    data[len(data) // 2] ^= 1
    with fs.open_output_stream(path) as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        T.read_tokens(spark, root).collect()


def test_empty(spark, empty):
    root = output_root(spark, "tokens-test")
    assert T.write_tokens(empty, root, T.vocabulary_path()) == []
    assert T.read_tokens(spark, root).collect() == []
    assert T.token_records(empty).collect() == []
