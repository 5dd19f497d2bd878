r"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a segment holds about ``SEGMENT_BYTES``
of text as one row of the stored table, with its sorted terms, the positions
of every term (zstandard-compressed postings), the length of each document and
a digest of each text. A search takes the benchmark's windows in blocks of at
most ``BLOCK_WORDS`` words, so what is sent to the tasks is bounded; per block
it sums the windows' term counts over all segments, and in every segment
intersects the offset-adjusted position lists of each window from its rarest
term on. ``slop`` = 0 gives exact phrases; with a larger one every word may
stand that many places from its own (proximity). No posting is shuffled.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. A window
is ``window`` consecutive words of an item; a shorter item is one window.

Defined results: a null text or item has no words; a null item_id is not
reported but its hits count; equal windows of several items count for each; repeated documents
are separate rows; an empty table gives no rows, an empty benchmark no hits.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import pieces, settle, table

WINDOW = 10
#: Text of one segment, empty places between its documents (more than any slop), and benchmark words searched at once.
SEGMENT_BYTES, GAP, BLOCK_WORDS = 4 << 20, 64, 400_000
#: Bytes to their lower case, others to spaces: digits, letters and everything beyond ASCII make words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


SEGMENT = pa.schema(
    [("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())]
)


def _segment(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """Terms in order of first use; their positions, ascending, one term after the other."""
    known: dict[bytes, int] = {}
    ids, places, lengths, at = [], [], [], 0
    for _, _, words in rows:
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        places.append(np.arange(at, at + len(words), dtype=np.int32))
        lengths.append(len(words))
        at += len(words) + GAP
    ids, places = np.concatenate(ids), np.concatenate(places)
    order = np.argsort(ids, kind="stable")
    postings = zstandard.ZstdCompressor(level=1).compress(np.diff(places[order], prepend=np.int32(0)).astype("<i4").tobytes())
    counts = np.bincount(ids, minlength=len(known)).astype(np.int32)
    columns = [[number], [[d for d, _, _ in rows]], [[g for _, g, _ in rows]], [lengths], [list(known)], [counts], [postings]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SEGMENT, strict=True)], schema=SEGMENT)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index of ``docs``, one row per segment."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        number, held, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], 0
        for part in pieces(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                held.append((doc_id, hashlib.md5(data).digest(), data.translate(TABLE).split()))
                size += len(data) + GAP
                if size >= segment_bytes:
                    yield _segment(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _segment(number, held)

    return settle(rows.mapInArrow(run, "segment long, doc_ids array<long>, digests array<binary>, lengths array<int>, terms array<binary>, counts array<int>, postings binary"), "positions")


class Phrases:
    """Distinct windows of a block of items: term numbers, lengths, and the items of each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.terms: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item_id, words in items:
            numbers = [self.terms.setdefault(w, len(self.terms)) for w in words]
            for at in range(max(1, len(numbers) - window + 1) if numbers else 0):
                found.setdefault(tuple(numbers[at : at + window]), set()).add(item_id)
        self.windows = [np.array(w, np.int32) for w in found]
        self.items = [sorted(i for i in own if i is not None) for own in found.values()]
        self.table = np.full((len(self.windows), window), -1, np.int32)
        for row, w in zip(self.table, self.windows, strict=True):
            row[: len(w)] = w

    def order_by(self, counts: np.ndarray) -> None:
        """Places of each window, rarest term first."""
        self.places = [np.argsort(counts[w], kind="stable") for w in self.windows]


def blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    """Items in blocks of bounded size; the driver holds one block."""
    held, size = [], 0
    for item_id, text in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = words_of(text)
        # a long item goes on in the next block, its last words again, so that no window is lost
        while size + len(words) > BLOCK_WORDS and len(words) > BLOCK_WORDS // 2:
            held.append((item_id, words[: BLOCK_WORDS // 2]))
            yield Phrases(held, window)
            held, size, words = [], 0, words[BLOCK_WORDS // 2 - window + 1 :]
        held.append((item_id, words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield Phrases(held, window)
            held, size = [], 0
    if held:
        yield Phrases(held, window)


def _numbers(terms: pa.Array, wanted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(local, wanted) numbers of the wanted terms of a segment."""
    pairs = [(k, wanted[t]) for k, t in enumerate(terms.to_pylist()) if t in wanted]
    return np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)


def term_counts(index: DataFrame, wanted: dict[bytes, int]) -> np.ndarray:
    """How often each wanted term occurs in all documents."""
    made = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for part in batches:
            for terms, counts in zip(part.column("terms"), part.column("counts"), strict=True):
                own, to = _numbers(terms.values, wanted)
                total[to] += np.asarray(counts.values)[own]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], schema=made)

    counts = np.zeros(len(wanted), np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    return counts


def occurrences(window: np.ndarray, places: np.ndarray, lists: dict[int, np.ndarray], slop: int) -> np.ndarray:
    """Starts of a window: position lists shifted by their place, intersected from the rarest term on."""
    starts = lists[int(window[places[0]])] - places[0]
    for k in places[1:]:
        if not len(starts):
            break
        own = lists[int(window[k])]
        low = np.searchsorted(own, starts + (k - slop), side="left")
        starts = starts[low < np.searchsorted(own, starts + (k + slop), side="right")]
    return starts


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document: segment, place, doc_id, digest, n_words and matches (item, start, end in words; runs of one item are joined)."""
    if slop * 2 >= GAP - window:
        raise ValueError("slop reaches over the gap between documents")
    spark = index.sparkSession
    match = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    made = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int32()), ("matches", match)])
    schema = "segment long, place int, doc_id long, digest binary, n_words int, matches array<struct<item:string,start:int,end:int>>"

    def searcher(phrases: Phrases):
        def run(batches):
            for part in batches:
                for seg in pieces([part], 1):
                    own, to = _numbers(seg.column("terms")[0].values, phrases.terms)
                    present = np.zeros(len(phrases.terms) + 1, bool)
                    present[to] = present[-1] = True
                    lengths = np.asarray(seg.column("lengths")[0].values)
                    firsts = np.concatenate(([0], np.cumsum(lengths[:-1] + GAP)))
                    hits: dict[int, dict] = {}
                    chosen = np.flatnonzero(present[phrases.table].all(axis=1)) if len(phrases.windows) else []
                    if len(chosen):
                        ends = np.cumsum(np.asarray(seg.column("counts")[0].values))
                        flat = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(seg.column("postings")[0].as_py()), "<i4"), dtype=np.int64)
                        lists = {int(t): flat[(ends[k - 1] if k else 0) : ends[k]] for k, t in zip(own, to, strict=True)}
                        for w in chosen:
                            for start in occurrences(phrases.windows[w], phrases.places[w], lists, slop).tolist():
                                size = len(phrases.windows[w])
                                doc = int(np.searchsorted(firsts, start + int(phrases.places[w][0]), side="right")) - 1
                                a = max(0, start - slop - int(firsts[doc]))
                                b = min(int(lengths[doc]), start + size + slop - int(firsts[doc]))
                                for item in phrases.items[w] or [None]:
                                    hits.setdefault(doc, {}).setdefault(item, []).append((a, b))
                    out = []
                    for doc in range(len(lengths)):
                        runs = []
                        for item, spans in hits.get(doc, {}).items():
                            first = None
                            for a, b in sorted(spans):
                                if first is not None and a <= runs[-1]["end"]:
                                    runs[-1]["end"] = max(runs[-1]["end"], b)
                                else:
                                    first = a
                                    runs.append({"item": item, "start": a, "end": b})
                        out.append(runs)
                    n = len(lengths)
                    columns = [pa.array(np.full(n, seg.column("segment")[0].as_py())), pa.array(np.arange(n, dtype=np.int32)), seg.column("doc_ids")[0].values, seg.column("digests")[0].values, pa.array(lengths), pa.array(out, match)]
                    yield pa.RecordBatch.from_arrays(columns, schema=made)

        return run

    found = None
    for phrases in blocks(items, id_col, text_col, window):
        phrases.order_by(term_counts(index, phrases.terms))
        block = index.mapInArrow(searcher(phrases), schema)
        found = block if found is None else found.unionByName(block)
    if found is None:
        empty = Phrases([], window)
        found = index.mapInArrow(searcher(empty), schema)
        return found
    grouped = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    return grouped.select("segment", "place", "doc_id", "digest", "n_words", "matches")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids and the text's digest."""
    found = search(build_index(docs), items, window=window, slop=slop)
    hit = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["end"] - 1))))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    out = found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(hit).cast("long").alias("n_hit"), ids.alias("item_ids"), F.col("digest").alias("text_md5"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids", "text_md5")


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids", "text_md5")


QUERIES = {"op3_contamination": op3_contamination}

SQL = {
    "op3_contamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (
  SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM bp),
ks AS (SELECT DISTINCT k FROM win),
dp AS (
  SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
hit AS (
  SELECT doc_id, i, d.k, item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM dp) d JOIN win USING (k, phrase)),
n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
}
