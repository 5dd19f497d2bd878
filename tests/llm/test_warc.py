import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from retentio.llm import warc as W
from retentio.llm.common import filesystem, output_root

BIG = "<p>" + "same " * 60 + "</p>"
PAGES = [
    (5, "http://a/5", BIG), (2, "http://a/2", BIG), (9, "http://a/9", BIG), (3, "http://a/3", "small"), (4, "http://a/4", "small"),
    (6, None, None), (7, "http://a/b c\r\nX: y", ""), (8, "u", "é" * 400), (8, "u", "é" * 400), (8, "v", "other" * 50), (1, "w", "other" * 50), (10, "z", "\r\n\r\n" * 100), (2**62, "far", "x" * 300_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "kind", "shard", "holder", "payload")}).repartition(4)


def test_round_trip(spark, pages):
    root = output_root(spark, "warc-test")
    W.write_warc(pages, root, shard_bytes=2000, roll_bytes=500)
    rows = W.read_warc(spark, root).collect()
    assert len(rows) == len(PAGES)
    assert len({r.record_id for r in rows}) == len(PAGES)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.page_id, []).append(r)
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        own = [r for r in by_id[page_id] if r.payload_digest == hashlib.sha256(data).hexdigest()]
        assert own and all(r.payload_bytes == len(data) for r in own)
        smallest = min(p for p, _, h in PAGES if h == html)
        if len(data) >= 100 and page_id != smallest:
            assert [(r.record_type, r.refers_to, r.payload) for r in own] == [("revisit", smallest, None)]
        else:
            assert own[0].record_type == "response" and own[0].payload == data
    # a row repeated as a whole revisits the first
    assert sorted(r.record_type for r in by_id[8]) == ["response", "revisit", "revisit"]


def test_same_bytes_whatever_the_partitions(spark, pages):
    written = []
    for n in (1, 5):
        root = output_root(spark, "warc-test")
        files = W.write_warc(pages.repartition(n), root, shard_bytes=2000, roll_bytes=500)
        fs, folder = filesystem(root)
        assert sorted(f.base_name for f in fs.get_file_info(__import__("pyarrow").fs.FileSelector(folder)) if not f.base_name.startswith(".")) == sorted([f["name"] for f in files] + ["manifest.json"])
        written.append(files)
    assert written[0] == written[1] and len(written[0]) > 3


def test_files_are_plain_gzip_members(spark, pages):
    root = output_root(spark, "warc-test")
    files = W.write_warc(pages, root)
    fs, folder = filesystem(root)
    with fs.open_input_stream(f"{folder}/{files[0]['name']}", compression=None) as f:
        data = f.read()
    assert hashlib.sha256(data).hexdigest() == files[0]["sha256"]
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC/1.1\r\n") == files[0]["records"] + 1


def test_damage_is_found(spark, pages):
    with pytest.raises(ValueError):
        W.parse_record(b"WARC/1.1\r\nContent-Length: 5\r\nWARC-Block-Digest: sha256:00\r\n\r\nabcde\r\n\r\n")
    with pytest.raises(ValueError):
        W.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabcde\r\n\r\n")


def test_null_ids_and_empty(spark, pages):
    root = output_root(spark, "warc-test")
    W.write_warc(pages.unionByName(pages.where("page_id = 5").withColumn("page_id", F.lit(None).cast("long"))), root)
    rows = {r.page_id: r for r in W.read_warc(spark, root).where(F.col("payload_digest") == hashlib.sha256(BIG.encode()).hexdigest()).collect()}
    assert rows[None].record_type == "response" and {rows[k].record_type for k in (2, 5, 9)} == {"revisit"}
    root = output_root(spark, "warc-test")
    assert W.write_warc(pages.where("false"), root) == []
    assert W.read_warc(spark, root).collect() == []
