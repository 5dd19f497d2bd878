"""Exact substring deduplication by longest-previous-factor arrays.

Texts are UTF-8 bytes. A window is a string of ``length`` bytes; windows are
equal only inside a text or across texts as they stand in the input.

1. Every window is named by its anchor, the smallest ``GRAM``-byte hash inside
   it. Neighbouring windows with one anchor form a run; equal windows have
   equal anchors at equal offsets, so an anchor that occurs once ends here.
   Only counts and digests are grouped, with map-side sums.
2. Runs of an anchor that are equal as a whole need no comparison. Of anchors
   with different runs, one copy of each run is cut from its text and dealt by
   anchor to suffix arrays: prefix doubling ranks all windows of a bucket in
   suffix order (cut at ``length``), and the previous and next smaller text
   positions in that order are where a window's longest previous factor
   starts. It is as long as the window where that neighbour has its rank:
   then the window is a later copy. The mirrored search, for larger positions,
   finds windows with a later copy.
3. An anchor with more than ``HOT`` different runs (a passage in very many
   texts: its edges differ) has its runs cut into slices by how far a window
   starts before the anchor. The windows of a slice share a core of bytes, and
   equal windows have equal cores, so slices with other cores need not meet:
   those inside the passage are equal as a whole, those over the edge have
   cores of their own. What still has more than ``HOT`` different slices of one
   core is cut again, at last into single windows.

Spans go back to their texts by digest. With ``keep="none"`` every copy of a
repeated window is removed, with ``keep="first"`` the one that comes first by
(doc_id, digest of the text, position), null doc_id last, stays.

Defined results: a null text is empty; texts shorter than a window keep all;
rows with equal texts share their spans, and with ``keep="first"`` the rows of
the smallest doc_id count as the first; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import pieces, settle, table

LENGTH, GRAM = 200, 48
#: Windows of a text handled at once, different runs from which an anchor is cut into slices, bytes of one suffix array.
BLOCK, HOT, ARRAY_BYTES = 1 << 20, 1024, 1 << 20
#: Distances to the anchor in one slice, by round.
STEPS = (16, 1)
PLACE = np.uint64(28)
BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
FACTORS = np.array([xxhash.xxh3_64_intdigest(f"factor {i}") | 1 for i in range(8)], np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a sum of powers of two) from each position on."""
    sizes = [1 << b for b in range(gram.bit_length()) if gram >> b & 1]
    level, at, done, total = BYTES[data], 1, 0, None
    for step in range(gram.bit_length()):
        if at in sizes:
            part = level[done : len(data) - gram + done + 1]
            total = part.copy() if total is None else total * FACTORS[7] + part[: len(total)]
            done += at
        if at * 2 <= gram:
            level = level[:-at] * FACTORS[step] + level[at:]
            at *= 2
    total = (total ^ (total >> np.uint64(33))) * FACTORS[6]
    return total ^ (total >> np.uint64(29))


def window_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, np.uint64]]:
    """(first window, windows, anchor offset, anchor hash) of each run."""
    out = []
    for begin in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[begin : begin + BLOCK + length - 1]
        hashes = gram_hashes(part, gram)
        # order by the high bits of the hash, then by place: the leftmost of equal ones
        low = (hashes >> PLACE << PLACE) | np.arange(len(hashes), dtype=np.uint64)
        span, reach = length - gram + 1, 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if span > reach:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        anchors = (low & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(anchors)) + 1))
        counts = np.diff(np.concatenate((starts, [len(anchors)])))
        at = anchors[starts]
        out += zip((starts + begin).tolist(), counts.tolist(), (at - starts).tolist(), hashes[at], strict=True)
    return out


def _runs(docs: DataFrame, length: int, places: bool) -> DataFrame:
    """Runs of all texts: anchor, digest, and with ``places`` their text, first doc_id, start, windows and offset."""
    names = ["anchor", "digest"] + ["key", "doc_id", "start", "windows"] * places

    def run(batches):
        for part in pieces(batches, 64):
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                runs = window_runs(data, length)
                if not runs:
                    continue
                cols[0] += np.array([h for *_, h in runs], np.uint64).view(np.int64).tolist()
                cols[1] += np.array([xxhash.xxh3_64_intdigest(raw[a : a + n + length - 1], o) for a, n, o, _ in runs], np.uint64).view(np.int64).tolist()
                if places:
                    cols[2] += [hashlib.md5(raw).digest()] * len(runs)
                    cols[3] += [doc_id] * len(runs)
                    cols[4] += [a for a, *_ in runs]
                    cols[5] += [n for _, n, *_ in runs]
            types = [pa.int64(), pa.int64()] + [pa.binary(), pa.int64(), pa.int64(), pa.int64()] * places
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.mapInArrow(run, "anchor long, digest long" + ", key binary, doc_id long, start long, windows long" * places)


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Dense rank of the ``length`` bytes from each position on (zeros behind the end), by prefix doubling."""
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8))).astype(np.uint64)
    n, have = len(data), 1
    value = padded
    while have < 8 and have * 2 <= length:
        value = value[:-have] << np.uint64(8 * have) | value[have:]
        have *= 2
    rank = np.unique(value[: n + length - have + 1], return_inverse=True)[1].astype(np.uint64)
    while have < length:
        step = min(have, length - have)
        pair = rank[: len(rank) - step] << np.uint64(32) | rank[step:]
        have += step
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    return rank[:n].astype(np.int64)


def smaller_neighbours(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of suffix order the previous and the next place with a smaller text position (-1 and n: none)."""
    n = len(position)
    walls = np.concatenate(([-1], position, [-1]))  # both ends are smaller than all
    out = []
    for step in (-1, 1):
        at = np.arange(1, n + 1) + step
        todo = np.flatnonzero(walls[at] > position)
        jump = np.concatenate(([0], at, [n + 1]))
        while len(todo):
            # follow the neighbour's own pointer: what lies between is larger than the neighbour
            at[todo] = jump[at[todo]]
            jump[1:-1] = at
            todo = todo[walls[at[todo]] > position[todo]]
        out.append(at - 1)
    return out[0], out[1]


def copies(rows: list[tuple[bytes, int]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of some texts, given in text order as (bytes, windows): owner, place, whether an earlier and a later copy exist."""
    data = np.frombuffer(b"".join(b for b, _ in rows), np.uint8)
    begins = np.cumsum([0] + [len(b) for b, _ in rows[:-1]])
    owner = np.repeat(np.arange(len(rows)), [n for _, n in rows])
    place = np.concatenate([np.arange(n) for _, n in rows])
    rank = suffix_ranks(data, length)[begins[owner] + place]
    order = np.argsort(rank, kind="stable")  # suffix order, equal windows by text position
    ranked = np.concatenate(([-1], rank[order], [-1]))
    found = []
    for position in (order, len(order) - 1 - order):
        before, after = smaller_neighbours(position)
        own = np.zeros(len(order), bool)
        # the longest previous factor is the longer match of the two; it is a whole window where ranks agree
        own[order] = (ranked[before + 1] == ranked[1:-1]) | (ranked[after + 1] == ranked[1:-1])
        found.append(own)
    return owner, place, found[0], found[1]


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of ascending numbers."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate(([0], cut + 1))].tolist(), (places[np.concatenate((cut, [len(places) - 1]))] + 1).tolist(), strict=True))


def _arrays(cut: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows of distinct runs, from suffix arrays: anchor, digest, from, to, earlier."""
    dealt = cut.select("anchor", "digest", "doc_id", "key", "start", "windows", "bytes")
    dealt = dealt.repartition("anchor").sortWithinPartitions("anchor", F.asc_nulls_last("doc_id"), "key", "start")

    def array(rows):
        # anchors may share an array; its rows stand in text order
        rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["key"], r["start"]))
        owner, place, earlier, later = copies([(r["bytes"], r["windows"]) for r in rows], length)
        out = []
        ends = np.cumsum([r["windows"] for r in rows])
        for i, r in enumerate(rows):
            own = slice(ends[i] - r["windows"], ends[i])
            for mask, flag in ((earlier[own], True), (later[own] & ~earlier[own], False)):
                out += [(r["anchor"], r["digest"], a, b, flag) for a, b in _ranges(np.flatnonzero(mask))]
        if out:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["anchor", "digest", "from", "to", "earlier"])

    def run(batches):
        held, size, last = [], 0, None
        for part in pieces(batches):
            for r in part.to_pylist():
                # arrays hold whole anchors; one has at most HOT runs
                if r["anchor"] != last and size > ARRAY_BYTES:
                    yield from array(held)
                    held, size = [], 0
                if held and r["anchor"] == last and (r["key"], r["start"], r["digest"]) == (held[-1]["key"], held[-1]["start"], held[-1]["digest"]):
                    continue  # a row repeated in the input
                last = r["anchor"]
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield from array(held)

    return dealt.mapInArrow(run, "anchor long, digest long, from long, to long, earlier boolean")


def run_slices(raw: bytes, windows: int, offset: int, step: int, length: int = LENGTH) -> list[tuple[int, int, bytes, int]]:
    """(first window, end, core, distance of the first window to the anchor) of the slices of a run.

    The core is what all windows at the slice's distances hold: it does not depend on where a run begins or ends.
    """
    out, at = [], 0
    while at < windows:
        band = (offset - at) // step
        end = min(windows, offset - band * step + 1)
        first = offset - (band + 1) * step + 1  # where the farthest window of the band would start
        out.append((at, end, raw[offset - band * step : first + length], offset - at))
        at = end
    return out


def _slices(hot: DataFrame, step: int, length: int) -> DataFrame:
    """Slices of runs: anchor and digest of the run, from, to, name (of the slice's core and distance), own (digest), place.
    ``hot``: anchor, digest, doc_id, key, start, windows, bytes."""

    def run(batches):
        for part in pieces(batches, 1024):
            out = []
            for r in part.to_pylist():
                raw = r["bytes"]
                offset = window_runs(np.frombuffer(raw, np.uint8), length)[0][2]  # all its windows have the run's anchor
                for a, b, core, far in run_slices(raw, r["windows"], offset, step, length):
                    name = xxhash.xxh3_64_intdigest(r["anchor"].to_bytes(8, "little", signed=True) + core, far // step)
                    own = xxhash.xxh3_64_intdigest(raw[a : b + length - 1], length + far)
                    out.append((r["anchor"], r["digest"], a, b, name, own, r["doc_id"], r["key"], r["start"] + a))
            if out:
                anchor, digest, a, b, name, own, doc_id, key, start = zip(*out, strict=True)
                signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (name, own)]
                plain = [pa.array(c, pa.int64()) for c in (anchor, digest, a, b)]
                yield pa.RecordBatch.from_arrays([*plain, *signed, pa.array(doc_id, pa.int64()), pa.array(key, pa.binary()), pa.array(start, pa.int64())], names=["anchor", "digest", "from", "to", "name", "own", "doc_id", "key", "start"])

    return hot.mapInArrow(run, "anchor long, digest long, from long, to long, name long, own long, doc_id long, key binary, start long")


def _compare(cut: DataFrame, length: int, steps: tuple[int, ...] | None = None) -> DataFrame:
    """Ranges of repeated windows of distinct runs: anchor, digest, from, to, earlier (has an earlier copy)."""
    steps = STEPS if steps is None else steps
    kinds = cut.groupBy("anchor").agg(F.countDistinct("digest").alias("kinds"))
    hot = settle(kinds.where(F.col("kinds") > HOT).select("anchor"), "hot-anchors")
    if not steps or hot.isEmpty():
        return _arrays(cut, length)
    cold = settle(_arrays(cut.join(hot, "anchor", "left_anti"), length), "repeats")
    # a row repeated in the input is one run
    runs = cut.join(hot, "anchor").dropDuplicates(["anchor", "digest"])
    slices = settle(_slices(runs, steps[0], length), "slices")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start")
    first = F.min(F.struct(place.alias("place"), "anchor", "digest", "from", "to")).alias("f")
    forms = settle(slices.groupBy("name", "own").agg(F.count("*").alias("n"), first), "slice-kinds")
    # slices equal as a whole: the first of all has no earlier copy but what is found below
    again = slices.join(forms.where("n > 1").select("name", "own", F.col("f.place").alias("first")), ["name", "own"])
    whole = again.select("anchor", "digest", "from", "to", (place != F.col("first")).alias("earlier"))
    # of different slices with one core, one of each kind is compared
    differ = settle(forms.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1").select("name"), "differing-slices")
    one = forms.join(differ, "name").select("name", "own", "f.*")
    if one.isEmpty():
        return cold.unionByName(whole)
    source = runs.select("anchor", "digest", "bytes")
    piece = F.expr(f"substring(bytes, cast(from + 1 as int), cast(to - from + {length - 1} as int))")
    inner = one.join(source, ["anchor", "digest"]).select(F.col("name").alias("anchor"), F.col("own").alias("digest"), "place.doc_id", "place.key", "place.start", (F.col("to") - F.col("from")).alias("windows"), piece.alias("bytes"))
    deeper = settle(_compare(settle(inner, "slice-bytes"), length, steps[1:]).select(F.col("anchor").alias("name"), F.col("digest").alias("own"), F.col("from").alias("a"), F.col("to").alias("b"), "earlier"), "slice-repeats")
    inside = one.join(deeper, ["name", "own"]).select("anchor", "digest", (F.col("from") + F.col("a")).alias("from"), (F.col("from") + F.col("b")).alias("to"), "earlier")
    return cold.unionByName(whole).unionByName(inside)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Byte ranges of repeated windows: key (MD5 of the text), from, to, first (only windows without an earlier copy).

    ``docs``: doc_id, text (not null).
    """
    anchors = _runs(docs, length, places=False).groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    anchors = settle(anchors.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("differ")), "anchors")
    # equal texts are one from here on
    runs = _runs(docs, length, places=True).groupBy("anchor", "digest", "key", "start", "windows").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    runs = settle(runs.join(anchors, "anchor"), "runs")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start")
    kinds = runs.groupBy("anchor", "digest").agg(F.min(order).alias("first"), F.sum("copies").alias("n"), F.max("differ").alias("differ"), F.max("windows").alias("windows"))
    kinds = settle(kinds.select("anchor", "digest", "first.doc_id", "first.key", "first.start", "n", "differ", "windows"), "kinds")
    wanted = kinds.where("differ").groupBy("key", "doc_id").agg(F.collect_list(F.struct("anchor", "digest", "start", "windows")).alias("runs"))
    own = docs.select(F.unhex(F.md5("text")).alias("key"), F.col("doc_id").alias("id"), "text")
    texts = own.join(wanted, "key").where(F.col("id").eqNullSafe(F.col("doc_id"))).select("key", "doc_id", "text", "runs")

    def cut(batches):
        for part in pieces(batches, 64):
            rows = part.to_pylist()
            out = [(x["anchor"], x["digest"], r["doc_id"], r["key"], x["start"], x["windows"], raw[x["start"] : x["start"] + x["windows"] + length - 1]) for r in rows for raw in (r["text"].encode(),) for x in r["runs"]]
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["anchor", "digest", "doc_id", "key", "start", "windows", "bytes"])

    pieces_of = settle(texts.mapInArrow(cut, "anchor long, digest long, doc_id long, key binary, start long, windows long, bytes binary"), "run-bytes")
    hits = settle(_compare(pieces_of, length), "hits")
    # a run that occurs again as a whole is repeated whole; its first copy has no earlier one but what the arrays found
    whole = runs.join(kinds.where("n > 1").select("anchor", "digest", F.col("key").alias("key0"), F.col("start").alias("start0")), ["anchor", "digest"])
    first = (F.col("key") == F.col("key0")) & (F.col("start") == F.col("start0"))
    spans = whole.select("key", F.col("start").alias("from"), (F.col("start") + F.col("windows")).alias("to"), first.alias("first"))
    inside = runs.join(hits, ["anchor", "digest"]).select("key", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"), (~F.col("earlier")).alias("first"))
    both = spans.unionByName(inside)
    return both.select("key", "from", (F.col("to") + length - 1).alias("to"), "first")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "none") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) and kept (bytes)."""
    if keep not in ("none", "first"):
        raise ValueError(keep)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(docs, length)
    grouped = settle(spans.groupBy("key").agg(F.collect_list(F.struct("from", "to", "first")).alias("found")), "spans")
    own = docs.withColumn("key", F.unhex(F.md5("text")))
    if keep == "first":
        firsts = settle(own.groupBy("key").agg(F.min("doc_id").alias("first_id")), "firsts")
        own = own.join(firsts, "key").withColumn("again", ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    else:
        own = own.withColumn("again", F.lit(True))
    joined = own.join(grouped, "key", "left").select("doc_id", "text", "found", "again")

    def run(batches):
        for part in pieces(batches, 64):
            out = []
            for doc_id, text, found, again in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "found", "again")), strict=True):
                raw = text.encode()
                if keep == "first" and again:  # a later row of an equal text
                    merged = [[0, len(raw)]] if len(raw) >= length else []
                else:
                    merged = []
                    for a, b in sorted((x["from"], x["to"]) for x in found or [] if keep == "none" or not x["first"]):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                out.append((doc_id, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"from": a, "to": b} for a, b in merged], kept))
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:long,to:long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("spans", "kept")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}
