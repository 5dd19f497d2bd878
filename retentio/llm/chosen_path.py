r"""N-gram Jaccard join by chosen paths.

Every text becomes the set of its five-word shingles. Texts with equal sets
form a class and take part once. A set's sketch holds ``TOKENS`` of its
shingles, sampled by min-wise hashes, so two sets hold the same shingle at a
place with the probability of their Jaccard similarity. A run starts all sets
in one node; every node samples ``BRANCHES`` pairs of places and sends each set
to the children named by its two shingles there. (With two shingles a name,
sets that only share a common passage, s = 0.4 say, part at 0.16 a child where
one shingle would keep 0.4; three branches make up for it at s = 0.8.) Nodes with one set end, those of at most
``SMALL`` sets are compared by brute force, larger ones are split again, up to
``DEPTH`` times. A larger node is split only while it can still tell something
new: its parts are first compared within themselves and with a few sets of the
whole node, which links a group of near copies. Where all but ``SMALL`` sets of
a node are linked by then, the node ends: the few others meet every part, and
pairs of linked sets need no further search. Two sets of similarity s part in a run with a probability
below the fixed point of q = (1 - s**2 q')**BRANCHES, q' = 1 - q; the number of
runs follows from it and the target recall.

Brute force compares sketches and only joins candidates into components, as
stars of few links. In each component all sets are then compared exactly on
their full shingles, so a pair that no run brought together is found too if
others connect it, and every reported link has Jaccard >= ``SIMILARITY``.
Large nodes are dealt to tasks in parts; each part sends on a few leaders whose
distances bound those of its members. Large components are dealt as pairs of
parts; only counts and spanning links leave a task, never all pairs.

Words are split at ASCII white space, A-Z lower-cased; a text of fewer than
five words is one shingle. Defined results: null and empty texts are equal
(one class); repeated rows are members of their class; a null doc_id is a
member, and names a class or group only if all its members' are null; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import pieces, settle, table
from retentio.llm.components import components

SHINGLE, SIMILARITY = 5, (4, 5)
TOKENS, BRANCHES, SMALL, DEPTH, TARGET_RECALL = 128, 3, 256, 5, 0.9999
#: Shares of equal places: of candidates (0.8 less four standard errors), of a leader and its members, of linked leaders.
#: Jaccard distance is a metric: members 0.2 apart have leaders within 2 * 0.2 + 0.2, and errors.
CANDIDATE, LED, LEADERS = 0.66, 0.8, 0.25
#: Sets of a large node, about, that meet all of its parts.
PIVOTS = 64
#: Sets of one part of a large component.
PART = 512
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ONE = np.uint64(0xFF51AFD7ED558CCD)
MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(TOKENS)], np.uint64)
WEIGHTS = np.array([xxhash.xxh3_64_intdigest(f"word {i}") | 1 for i in range(SHINGLE)], np.uint64)


def runs_needed(similarity: float = SIMILARITY[0] / SIMILARITY[1], recall: float = TARGET_RECALL, branches: int = BRANCHES) -> int:
    """Runs after which a pair of just ``similarity`` has met with probability ``recall``."""
    lost = 0.0
    for _ in range(200):
        lost = (1 - similarity**2 * (1 - lost)) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * ONE
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; empty if there are no words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[ids]
    n = len(words) - SHINGLE + 1
    if n < 1:
        return mix((hashes * WEIGHTS[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    total = hashes[:n] * WEIGHTS[0]
    for k in range(1, SHINGLE):
        total = total + hashes[k : k + n] * WEIGHTS[k]
    return np.unique(mix(total))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Of each place the smallest hash, cut to 32 bits; equal hashes are equal shingles."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        low = np.minimum(low, (tokens[at : at + 4096, None] * MULTIPLIERS).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, set (a 64-bit digest of the shingles; equal sets only), sketch, text_md5."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for part in pieces(batches):
            keys, made, texts = [], [], []
            for text in part.column("text").to_pylist():
                tokens = shingles(text)
                texts.append(hashlib.md5((text or "").encode()).digest())
                keys.append(xxhash.xxh3_64_intdigest(tokens.tobytes()))
                made.append(sketch(tokens).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(made, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "set", "sketch", "text_md5"])

    return rows.mapInArrow(run, "doc_id long, set long, sketch binary, text_md5 binary")


def split(rows: DataFrame) -> DataFrame:
    """Children of nodes: (path, set) for rows of path, set and sketch."""

    def run(batches):
        for part in pieces(batches, 4096):
            values = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32).reshape(-1, TOKENS)
            path = np.asarray(part.column("path")).view(np.uint64)
            out = []
            for b in range(BRANCHES):
                chosen = mix(path * MULTIPLIERS[b] + np.uint64(b + 1))
                first = (chosen % np.uint64(TOKENS)).astype(np.int64)
                other = (first + 1 + (chosen // np.uint64(TOKENS) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
                rows = np.arange(len(path))
                name = values[rows, first].astype(np.uint64) << np.uint64(32) | values[rows, other]
                out.append(mix(chosen + mix(name) * MULTIPLIERS[BRANCHES]).view(np.int64))
            sets = np.asarray(part.column("set"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(sets, BRANCHES))], names=["path", "set"])

    # branches of a node may choose the same places: a set counts once in a child
    return rows.select("path", "set", "sketch").mapInArrow(run, "path long, set long").distinct()


def _stars(root: np.ndarray, sets: list[int]) -> list[tuple[int, int]]:
    """(smallest set of a component, other set of it): contraction needs few rounds on stars from the smallest node."""
    least: dict[int, int] = {}
    for r, s in zip(root.tolist(), sets, strict=True):
        least[r] = min(s, least.get(r, s))
    return [(least[r], s) for r, s in zip(root.tolist(), sets, strict=True) if s != least[r]]


def _alike(sketched: np.ndarray, share: float) -> np.ndarray:
    """Component numbers of rows, where rows that agree in at least ``share`` of their places are linked."""
    root = np.arange(len(sketched))
    for i in range(1, len(sketched)):
        near = np.flatnonzero((sketched[:i] == sketched[i]).mean(axis=1) >= share)
        for r in np.unique(root[near]):
            root[root == r] = i
    return root


def _leaders(sketched: np.ndarray) -> list[int]:
    """Rows so that every other agrees with one of them in a share of ``LED``."""
    chosen: list[int] = []
    for i in range(len(sketched)):
        if not chosen or (sketched[chosen] == sketched[i]).mean(axis=1).max() < LED:
            chosen.append(i)
    return chosen


def _groups(batches, key: list[str]):
    """(key, sets, sketches) of runs of equal keys in sorted rows."""
    held, sets, values = None, [], []
    for part in pieces(batches, 4096):
        for *k, s, v in zip(*(part.column(c).to_pylist() for c in (*key, "set", "sketch")), strict=True):
            if k != held:
                if sets:
                    yield held, sets, np.frombuffer(b"".join(values), np.uint32).reshape(-1, TOKENS)
                held, sets, values = k, [], []
            sets.append(s)
            values.append(v)
    if sets:
        yield held, sets, np.frombuffer(b"".join(values), np.uint32).reshape(-1, TOKENS)


def _compared(dealt: DataFrame) -> DataFrame:
    """Links (path, a, b) of alike sets inside parts of nodes and, where ``led``, leaders (path, a, sketch) of the parts.
    ``dealt``: path, part, led, set, sketch."""
    dealt = dealt.repartition("path", "part").sortWithinPartitions("path", "part", "set")

    def compare(batches):
        for (path, _, led), sets, values in _groups(batches, ["path", "part", "led"]):
            out = [(path, a, b, None) for a, b in _stars(_alike(values, CANDIDATE), sets)]
            if led:
                out += [(path, sets[i], None, values[i].tobytes()) for i in _leaders(values)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["path", "a", "b", "sketch"])

    return dealt.mapInArrow(compare, "path long, a long, b long, sketch binary")


def _in_parts(large: DataFrame, everywhere) -> DataFrame:
    """(path, part, led, set) of large nodes in parts of about ``SMALL`` sets; those ``everywhere`` are in all parts."""
    parts = F.ceil(F.col("n") / SMALL)
    part = F.when(everywhere, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("set"), parts)))
    return large.select("path", F.explode(part).alias("part"), F.lit(False).alias("led"), "set")


def _ended(large: DataFrame, reps: DataFrame, known: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Large nodes of almost only linked sets, dealt in parts, and the rows of the other nodes. ``known``: links so far, added to."""
    pivot = F.pmod(F.xxhash64("path", "set"), F.col("n")) < PIVOTS
    known.append(settle(_compared(_in_parts(large, pivot).join(reps, "set")).select("a", "b").distinct(), "known-links"))
    links = known[0]
    for more in known[1:]:
        links = links.unionByName(more)
    near = components(links).withColumnRenamed("node", "set")
    placed = settle(large.join(near, "set", "left").withColumn("root", F.coalesce("root", "set")), "placed")
    counts = placed.groupBy("path", "root").agg(F.count("*").alias("c")).groupBy("path").agg(F.max(F.struct("c", "root")).alias("most"))
    placed = placed.join(settle(counts, "largest-groups"), "path").withColumn("others", F.col("n") - F.col("most.c"))
    # linked sets meet once more, with the others: all pairs of the node but those of linked sets are compared
    ended = _in_parts(placed.where((F.col("others") > 0) & (F.col("others") <= SMALL)), F.col("root") != F.col("most.root"))
    return ended, settle(placed.where(F.col("others") > SMALL).select("path", "n", "set"), "open-nodes")


def candidates(reps: DataFrame, runs: int) -> DataFrame:
    """Links (a, b) that connect all sets which meet in a node and look alike. ``reps``: set, sketch."""
    roots = F.explode(F.array(*[F.lit(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(f"run {r}")).view(np.int64)))) for r in range(runs)]))
    rows, leaves, known = split(reps.withColumn("path", roots)), None, []
    for level in range(1, DEPTH + 1):
        rows = settle(rows, "paths")
        many = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        rows = settle(rows.join(settle(many, "nodes"), "path"), "full-nodes")
        small = rows.where(F.col("n") <= SMALL).select("path", F.lit(0).cast("long").alias("part"), F.lit(False).alias("led"), "set")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = rows.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        ended, large = _ended(large, reps, known)
        leaves = leaves.unionByName(ended)
        if level == DEPTH:
            # large nodes that are not split further are dealt in parts, whose leaders meet
            leaves = leaves.unionByName(_in_parts(large, F.lit(False)).withColumn("led", F.lit(True)))
        elif large.isEmpty():
            break
        else:
            rows = split(large.join(reps, "set"))
    found = settle(_compared(leaves.join(reps, "set")), "candidates")

    def connect(batches):
        for _, sets, values in _groups(batches, ["path"]):
            links = _stars(_alike(values, LEADERS), sets)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    leaders = found.where("b is null").select("path", F.col("a").alias("set"), "sketch").repartition("path").sortWithinPartitions("path", "set")
    # a leader's members: links inside a part are at CANDIDATE, below LED, so they connect them
    links = found.where("b is not null").select("a", "b").union(leaders.mapInArrow(connect, "a long, b long"))
    for more in known:
        links = links.unionByName(more)
    return links


def _exact(sets: list[np.ndarray], sizes: np.ndarray, first: int, weights: np.ndarray):
    """Links of Jaccard >= SIMILARITY: weight of each row's partners, and component numbers.

    With ``first`` > 0 only pairs across that border count.
    """
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    owner_by_token, starts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(tokens)))))
    ends = np.cumsum(sizes)
    root = np.arange(len(sets))
    partners = np.zeros(len(sets), np.int64)
    for i in range(first, len(sets)):
        own = place[ends[i] - sizes[i] : ends[i]]
        shared = np.zeros(len(sets), np.int64)
        for at in range(0, len(own), 512):
            shared += np.bincount(np.concatenate([owner_by_token[starts[t] : starts[t + 1]] for t in own[at : at + 512]]), minlength=len(sets))
        limit = first or i
        union = sizes[i] + sizes[:limit] - shared[:limit]
        near = np.flatnonzero((SIMILARITY[1] * shared[:limit] >= SIMILARITY[0] * union) & (shared[:limit] > 0))
        if len(near):
            partners[i] += weights[near].sum()
            partners[near] += weights[i]
            for r in np.unique(root[near]):
                root[root == r] = root[i]
    return partners, root


def verify(texts: DataFrame) -> DataFrame:
    """Exact links inside components: rows (set, partners) and (set, other). ``texts``: root, set, size, members, text."""
    parts = F.ceil(F.col("size") / PART).cast("int")
    own = F.pmod(F.xxhash64("set"), parts).cast("int")
    # a row meets its own part and, part by part, every other one
    dealt = texts.withColumns({"parts": parts, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "set", "members", "text")
    dealt = dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "own", "set")

    def run(batches):
        def close(key, rows):
            sets = [shingles(t) for _, _, t, _ in rows]
            sizes = np.array([len(s) for s in sets])
            first = sum(o == key[1] for _, _, _, o in rows) if key[1] != key[2] else 0
            if first == len(rows) or len(rows) < 2 or not sizes.all():
                return
            partners, root = _exact(sets, sizes, first, np.array([m for _, m, _, _ in rows], np.int64))
            out = [(rows[i][0], int(n), None) for i, n in enumerate(partners) if n] + [(a, 0, b) for a, b in _stars(root, [s for s, *_ in rows])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["set", "partners", "other"])

        held, rows = None, []
        for part in pieces(batches):
            for root, p, q, o, s, m, t in zip(*(part.column(c).to_pylist() for c in ("root", "p", "q", "own", "set", "members", "text")), strict=True):
                if (root, p, q) != held:
                    if rows:
                        yield from close(held, rows)
                    held, rows = (root, p, q), []
                rows.append((s, m, t, o))
        if rows:
            yield from close(held, rows)

    return dealt.mapInArrow(run, "set long, partners long, other long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (smallest id of an equal set), n_links (documents of Jaccard >= 0.8, equal ones
    included, itself not) and group_id (smallest id among all that are linked, over any number of links); also set,
    root (a set that names the group) and text_md5."""
    every = settle(sketches(docs, id_col, text_col), "sketches")
    firsts = [F.min("doc_id").alias("class_id"), F.count("*").alias("members"), F.min("sketch").alias("sketch"), F.min("text_md5").alias("text_md5")]
    classes = settle(every.groupBy("set").agg(*firsts), "classes")
    near = components(candidates(classes.select("set", "sketch"), runs_needed()))
    sized = settle(near.withColumnRenamed("node", "set").join(settle(near.groupBy("root").agg(F.count("*").alias("size")), "sizes"), "root"), "near")
    # one text for each class in a component, found by its digest: ids may be null or repeat
    chosen = sized.join(classes.select("set", "text_md5", "members"), "set")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.unhex(F.md5(text)).alias("text_md5"), text.alias("text"))
    texts = own.join(chosen, "text_md5").groupBy("root", "set", "size", "members").agg(F.min("text").alias("text"))
    checked = settle(verify(texts), "links")
    links = components(checked.where("other is not null").select(F.col("set").alias("a"), F.col("other").alias("b")))
    partners = checked.groupBy("set").agg(F.sum("partners").alias("partners"))
    found = classes.drop("sketch", "text_md5").join(partners, "set", "left").join(links.withColumnRenamed("node", "set"), "set", "left")
    found = settle(found.withColumn("root", F.coalesce("root", "set")), "found")
    groups = settle(found.groupBy("root").agg(F.min("class_id").alias("group_id")), "groups")
    named = settle(found.join(groups, "root").select("set", "class_id", (F.coalesce("partners", F.lit(0)) + F.col("members") - 1).alias("n_links"), "group_id", "root"), "named")
    return every.select("doc_id", "set", "text_md5").join(named, "set").select("doc_id", "class_id", "n_links", "group_id", "set", "root", "text_md5")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of linked documents: that of the smallest id (ties: of the smallest set, then text)."""
    joined = jaccard_join(docs, id_col, text_col)
    first = joined.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("root").agg(F.min(F.struct("set", "text_md5", "doc_id")).alias("f"))
    name = lambda doc_id, md5: F.concat_ws(":", F.lower(F.hex(md5)), doc_id.cast("string"))
    first = settle(first.select(name(F.col("f.doc_id"), F.col("f.text_md5")).alias("_first")), "firsts")
    own = docs.withColumn("_own", name(F.col(id_col).cast("long"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))))
    # rows that repeat both id and text are one document
    return own.join(first, F.col("_own") == F.col("_first")).dropDuplicates(["_own"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("set", "root", "text_md5")


QUERIES = {"op10_jaccard_join": op10_jaccard_join}

SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(w[i:least(i + 4, len(w))], ' ')) END)) AS s FROM d),
m AS (SELECT doc_id, md5(array_to_string(s, chr(10))) AS k, s FROM t),
c AS (SELECT k, min(doc_id) AS class_id, count(*) AS members, any_value(s) AS s FROM m GROUP BY k),
x AS (SELECT k, class_id, members, len(s) AS n, unnest(s) AS g FROM c),
p AS (
  SELECT a.k AS a, b.k AS b, any_value(b.members) AS other, count(*) AS i, any_value(a.n) + any_value(b.n) - count(*) AS u
  FROM x a JOIN x b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k),
l AS (SELECT a, b, other FROM p WHERE 5 * i >= 4 * u),
r AS (SELECT k AS a, class_id AS r FROM c UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.a),
g AS (SELECT a AS k, min(r) AS group_id FROM r GROUP BY a)
SELECT m.doc_id, c.class_id, CAST(c.members - 1 + coalesce(o.n, 0) AS BIGINT) AS n_links, g.group_id
FROM m JOIN c USING (k) JOIN g USING (k) LEFT JOIN (SELECT a AS k, sum(other) AS n FROM l GROUP BY a) o USING (k)
"""
}
