"""Deterministic sharded WARC writer and reader.

Pages are dealt to shards by ranges of page_id that hold about ``SHARD_BYTES``
of payload and sorted inside them; a shard's records are gzip members written
to files that roll at ``ROLL_BYTES`` compressed. Every header is generated
anew: identifiers from page_id, one fixed date, SHA-256 digests of block and
payload. Of pages with equal payloads of at least ``MIN_DEDUP_BYTES`` the one
with the smallest page_id holds the payload; the others are revisit records.
Ranges, order, headers and compression depend on the rows only, so a rerun and
a retried task write the same bytes. Files are written under temporary names
and renamed; the manifest is written last.

Digests are grouped with map-side sums, and only those that occur again are
joined to the pages, on slim rows; the html moves once, to its shard.

Defined results: null html is an empty payload, a null url an empty target; a
null page_id comes first and counts as the smallest; rows that repeat a page_id are
separate records, the first by digest order holding the payload; an empty
table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import batch, commit_file, filesystem, id_cuts, output_root, pieces, settle, shard_of, table

SHARD_BYTES, ROLL_BYTES, MIN_DEDUP_BYTES = 16 << 20, 4 << 20, 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("8f2f4f6e-3b7e-5d0b-9a53-0d6f6f1c7a11")


def record_id(page_id: int | None, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{ordinal}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time stamp
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def make_record(page_id: int | None, ordinal: int, url: str | None, payload: bytes, digest: str, refers_to: tuple | None) -> bytes:
    """One record; ``refers_to`` is (page_id, ordinal) of the record that holds the payload, or None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, ordinal)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if page_id is not None:
        headers.append(("Page-Id", str(page_id)))
    if refers_to:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers_to))]
        if refers_to[0] is not None:
            headers.append(("Refers-To-Page-Id", str(refers_to[0])))
    return _member(headers, block)


def _file_header(name: str) -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


class _Roller:
    """Writes members to files of one shard, each closed once it passes the size."""

    def __init__(self, fs, folder: str, shard: int, roll: int):
        self.fs, self.folder, self.shard, self.roll, self.part, self.out, self.done = fs, folder, shard, roll, 0, None, []

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.folder}/_tmp-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, -1, hashlib.sha256()
            self.write(_file_header(self.name))
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            commit_file(self.fs, self.temporary, f"{self.folder}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.part += 1


def first_holders(pages: DataFrame) -> DataFrame:
    """(digest, holder) of payloads that occur more than once: the smallest page_id, null first.

    ``pages``: page_id, bytes, digest.
    """
    many = pages.where(F.col("bytes") >= MIN_DEDUP_BYTES).groupBy("digest")
    return many.agg(F.count("*").alias("n"), F.min("page_id").alias("low"), F.max(F.col("page_id").isNull()).alias("none")).where("n > 1").select("digest", F.when(~F.col("none"), F.col("low")).alias("holder"))


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> list[dict]:
    """Write a record per row below ``root``; returns the manifest's files in record order."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    slim = pages.select("page_id", F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("digest"))
    cuts = np.array(id_cuts(pages, "page_id", F.octet_length("html") + 512, shard_bytes), np.int64)
    # written first, so that the join below moves both sides by digest and a hot digest can be split
    holders = settle(first_holders(slim), "warc-holders")
    again = slim.join(holders, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.lit(0).alias("kind"), F.col("holder")).distinct()
    own = pages.select("page_id", "url", F.encode("html", "utf-8").alias("payload"), F.sha2("html", 256).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("holder"))
    both = again.unionByName(own)
    schema = both.schema

    def deal(batches):
        for part in batches:
            yield part.append_column("shard", pa.array(shard_of(part.column("page_id"), cuts)))

    listed = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches):
        fs, folder = filesystem(root)
        roller, shard, page, refers, seen = None, None, (), {}, {}
        for part in pieces(batches, 64):
            for row in part.to_pylist():
                if row["shard"] != shard:
                    if roller:
                        roller.close()
                        yield from map(lambda d: batch(listed, [[x] for x in d]), roller.done)
                    shard, page = row["shard"], ()
                    roller = _Roller(fs, folder, shard, roll_bytes)
                if (row["page_id"],) != page:
                    page, refers, ordinal, seen = (row["page_id"],), {}, 0, {}
                digest = row["digest"]
                if row["kind"] == 0:
                    refers[digest] = row["holder"]
                    continue
                # pages that repeat an id come in digest order; the first of a digest has the lowest place among its equals
                refers_to = None
                if digest in refers and (refers[digest] != row["page_id"] or digest in seen):
                    refers_to = (refers[digest], seen.get(digest, 0))
                seen.setdefault(digest, ordinal)
                roller.write(make_record(row["page_id"], ordinal, row["url"], row["payload"], digest, refers_to))
                ordinal += 1
        if roller:
            roller.close()
            yield from map(lambda d: batch(listed, [[x] for x in d]), roller.done)

    fs, folder = filesystem(root)
    fs.create_dir(folder, recursive=True)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", shard int"
    parts = both.mapInArrow(deal, columns).repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "page_id", "kind", "digest", "url")
    files = sorted((r.asDict() for r in parts.mapInArrow(write, "name string, records long, bytes long, sha256 string").collect()), key=lambda r: r["name"])
    temporary = f"{folder}/_tmp-manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(json.dumps({"format": "WARC/1.1", "files": files}).encode())
    commit_file(fs, temporary, f"{folder}/manifest.json")
    return files


def members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one at a time."""
    data = stream.read(size)
    while data:
        press, out = zlib.decompressobj(31), []
        while not press.eof:
            if not data and not (data := stream.read(size)):
                raise ValueError("cut gzip member")
            out.append(press.decompress(data))
            data = press.unused_data
        yield b"".join(out)
        data = data or stream.read(size)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; a wrong length or block digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(": "), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or ("WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}"):
        raise ValueError("damaged record")
    return headers, block


def read_warc(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """Page records of all files of the manifest, in files' order inside each partition."""
    fs, folder = filesystem(root)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    schema = "file string, page_id long, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    if not files:
        return spark.createDataFrame([], schema)
    text = [("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    made = pa.schema(text + [("payload", pa.binary())] * with_payload)

    def read(batches):
        fs, folder = filesystem(root)
        for part in batches:
            for name in part.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{folder}/{name}", compression=None, buffer_size=1 << 20) as stream:
                    for member in members(stream):
                        headers, block = parse_record(member)
                        kind = headers["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: damaged payload")
                        ids = [int(headers[k]) if k in headers else None for k in ("Page-Id", "Refers-To-Page-Id")]
                        rows.append((name, ids[0], headers["WARC-Target-URI"], headers["WARC-Record-ID"], size, digest, kind, ids[1]) + (payload if kind == "response" else None,) * with_payload)
                        if len(rows) == 64:
                            yield batch(made, list(zip(*rows, strict=True)))
                            rows = []
                if rows:
                    yield batch(made, list(zip(*rows, strict=True)))

    listed = spark.createDataFrame([(f["name"],) for f in files], "name string")
    return listed.repartition(len(files)).mapInArrow(read, schema)


def op4_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = output_root(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), root)
    return read_warc(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_records": op4_warc_records}

SQL = {
    "op4_warc_records": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
}
