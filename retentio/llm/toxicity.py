"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

The fit takes a bounded sample of labelled ids (``SAMPLE_PER_CLASS`` of each
label, lowest hash first; equal texts once, one text an id), all of their terms,
and the terms' document frequencies over all documents. A term is a word cut to
its first ``LETTERS`` letters, so unseen inflections of a known word count too.
Vectors are plain TF-IDF, ``(1 + ln tf) * (ln((N + 1) / (df + 1)) + 1)``, of
length 1.

The index is block-max: examples lie in blocks of ``BLOCK``, texts of one kind
(same commonest term, same heaviest term) beside each other. For each term there
is a row a block that holds it: the largest weight there, and the sorted
postings. A search adds the postings of rare terms, and bounds each block by the
largest such sum in it plus the block maxima of the common terms. It reads blocks from
the highest bound on and leaves out every block whose bound is below the k-th best
sum found. Several texts go through a block together. Single precision only picks
the examples that can be among the nearest; their cosines are summed again in
double precision over their own terms, so the neighbours are those of a
comparison with every example; equal cosines go by doc_id.

A neighbour votes with a weight that grows as its distance falls, times the
squared share of the cosine that comes from terms used differently by the two
labels (``factor``, from a term's z); the vectors themselves know no labels. A
logistic curve, fitted on leave-one-out votes of the examples weighted to the
labels' true shares, turns votes into calibrated scores. The strongest votes
are the evidence.

Spark builds the index (aggregates and joins) and writes it to the shared
folder, where tasks read it; the driver sees counts and a histogram of votes.
The index is bounded by the sample, whatever the size of the tables; documents
never leave their task.

Defined results: a null or empty text, and one without any known term, gets
the score of no neighbours; rows without a label train nothing; a doc_id
labelled twice is toxic if any of its labels says so; repeated rows are scored
alike; without both labels in the sample every score is the share of toxic
labels (0 without labels). Other columns are kept as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.llm.common import files_of, kept, pieces, settle, table
from retentio.plans.lineage import scratch_path

SAMPLE_PER_CLASS = 3000
#: |z| at which a term counts about half in a vote, and what a term without any difference counts.
HALF_Z, LEAST = 5.0, 0.01
#: Examples of a block; share of the examples from which a term is common; texts and characters searched together.
BLOCK, COMMON, TOGETHER, TOGETHER_CHARS = 64, 1 / 20, 64, 400_000
#: Texts and characters whose words are looked at together.
COUNTED, COUNTED_CHARS = 1024, 2_000_000
#: Neighbours that vote, votes that are shown, weight of the prior, steps of the votes' log odds.
NEIGHBOURS, EVIDENCE, PRIOR_VOTES, STEP = 100, 15, 0.05, 0.01
#: What single precision can lose of a cosine, with room; tasks of the sample.
LOST, SAMPLE_PARTITIONS = 1e-4, 12
LETTERS = 4
#: ASCII but letters.
NO_LETTERS = "".join(c for c in map(chr, range(128)) if not c.isalpha())
TERM = re.compile(rf"([^\W\d_]{{1,{LETTERS}}})[^\W\d_]*")


def terms_of(text: str | None) -> dict[str, int]:
    """Term counts of a text."""
    return dict(Counter(TERM.findall((text or "").lower())))


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one behind another."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def counted(terms: dict[str, int], texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, terms, counts): the known terms of text i, ascending, are those from ``ends[i]`` to ``ends[i + 1]``.

    Terms are sought once in each distinct word (no term and no rule of lower
    case goes across a space or a line end), by Arrow in plain words of Latin letters.
    """
    n, none = len(terms), pa.scalar("", pa.large_string())
    cut = pc.split_pattern(pc.replace_substring(pc.fill_null(pa.array(texts, pa.large_string()), ""), "\n", " "), " ")
    coded = cut.flatten().dictionary_encode()
    words = pc.ascii_trim(coded.dictionary, NO_LETTERS)
    plain = pc.match_substring_regex(words, "^[A-Za-zÀ-ÖØ-öø-ÿ]*$")
    begin = pc.utf8_slice_codeunits(pc.utf8_lower(pc.if_else(plain, words, none)), 0, LETTERS).dictionary_encode()
    code = np.array([terms.get(t, -1) for t in begin.dictionary.to_pylist()], np.int64)[begin.indices.to_numpy()]
    rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    found = [[terms[t] for t in TERM.findall(w.lower()) if t in terms] for w in words.take(pa.array(rest)).to_pylist()]
    one, sizes = code >= 0, (code >= 0).astype(np.int64)
    sizes[rest] = [len(f) for f in found]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.zeros(ends[-1], np.int64)
    codes[ends[:-1][one]] = code[one]
    codes[spans(ends[rest], ends[rest + 1])] = list(chain.from_iterable(found))
    word = coded.indices.to_numpy()
    lo, hi = ends[word], ends[word + 1]
    doc = np.repeat(np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy())), hi - lo)
    cells, k = np.unique(codes[spans(lo, hi)] + doc * n, return_counts=True)
    doc, at = np.divmod(cells, max(n, 1))
    return np.searchsorted(doc, np.arange(len(texts) + 1)), at, k


def _read(path: str, columns: list[str]) -> pa.Table:
    """A table of the index, its files in the order of their ranges."""
    fs, files = files_of(path)
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=fs) for f in files])


def _together(texts: list, count: int, chars: int) -> Iterator[slice]:
    """Slices of few texts and few characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if i + 1 - start == count or size > chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _numbers(terms: pa.Table) -> dict[str, int]:
    return {t: i for i, t in enumerate(terms.column("term").to_pylist())}


class Index:
    """Block-max inverted index of the labelled examples, as a task reads it."""

    def __init__(self, root: str):
        terms = _read(f"{root}/terms", ["number", "term", "idf", "factor"])
        self.terms, numbers = _numbers(terms), terms.column("number").to_numpy()
        self.idf, self.factor = (terms.column(c).to_numpy() for c in ("idf", "factor"))
        examples = _read(f"{root}/examples", ["place", "id", "y"]).sort_by("place")
        self.ids, self.labels = (examples.column(c).to_numpy() for c in ("id", "y"))
        n, t = len(self.ids), len(self.terms)
        self.blocks = -(-n // BLOCK)
        rows = _read(f"{root}/blocks", ["number", "block", "best", "places", "weights"]).combine_chunks()
        first = np.searchsorted(rows.column("number").to_numpy(), np.append(numbers, np.iinfo(np.int64).max))
        block, best = rows.column("block").to_numpy(), rows.column("best").to_numpy()
        start = np.concatenate(([0], np.cumsum(rows.column("places").combine_chunks().value_lengths().to_numpy(), dtype=np.int64)))
        #: Postings, those of term t from ``start[t]`` to ``start[t + 1]``.
        self.place, self.weight = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("places", "weights"))
        self.start = start[first]
        common = np.flatnonzero(np.diff(self.start) >= max(1, COMMON * n))
        #: Column of a common term, -1 for the others; its weights in the examples, and its largest weight in each block.
        self.column = np.full(t, -1, np.int64)
        self.column[common] = np.arange(len(common))
        self.weights = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        self.maxima = np.zeros((len(common), self.blocks), np.float32)
        for c, term in enumerate(common):
            p, r = slice(self.start[term], self.start[term + 1]), slice(first[term], first[term + 1])
            self.weights[self.place[p] // BLOCK, c, self.place[p] % BLOCK] = self.weight[p]
            self.maxima[c, block[r]] = best[r]
        #: The terms of each example.
        order = np.argsort(self.place, kind="stable")
        self.of = np.repeat(np.arange(t, dtype=np.int32), np.diff(self.start))[order]
        self.x = self.weight[order]
        self.ends = np.searchsorted(self.place[order], np.arange(n + 1))

    def vector(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Normalized weights of terms and their counts."""
        w = (1 + np.log(k)) * self.idf[at]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def sums(self, vectors: list[tuple], k: int, skips: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums (texts by examples, in single precision) and the blocks read (texts by blocks); of other blocks no example is among a text's k nearest."""
        m, n = len(vectors), len(self.ids)
        size = np.array([len(at) for at, _ in vectors])
        text, at, w = np.repeat(np.arange(m), size), np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])
        column = self.column[at]
        asked = np.zeros((m, len(self.maxima)), np.float32)
        asked[text[column >= 0], column[column >= 0]] = w[column >= 0]
        text, at, w = text[column < 0], at[column < 0], w[column < 0]
        lo, hi = self.start[at], self.start[at + 1]
        p, times = spans(lo, hi), hi - lo
        wide = self.blocks * BLOCK
        near = np.bincount(np.repeat(text * wide, times) + self.place[p], np.repeat(w, times) * self.weight[p], m * wide).astype(np.float32).reshape(m, self.blocks, BLOCK)
        if skips is not None:
            near[np.arange(m), np.array(skips) // BLOCK, np.array(skips) % BLOCK] = -np.inf
        bound = near.max(2) + asked @ self.maxima
        order = np.argsort(np.argsort(-bound, 1, kind="stable"), 1)
        read, least, upto = np.zeros((m, self.blocks), bool), np.zeros(m, np.float32), -(-2 * k // BLOCK)
        while True:
            now = ~read & (order < upto) & (bound > 0) & (bound >= least[:, None] - LOST)
            for b in np.flatnonzero(now.any(0)):
                who = np.flatnonzero(now[:, b])
                near[who, b] += asked[who] @ self.weights[b]
            read |= now
            if upto >= self.blocks:
                return near.reshape(m, wide)[:, :n], read
            if n > k:
                least = np.maximum(np.partition(near.reshape(m, wide), wide - k, 1)[:, wide - k], 0)
            upto *= 3

    def nearest(self, vectors: list[tuple], k: int = NEIGHBOURS, skips: list | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each vector (places, cosines, telling parts of the cosines) of the k examples of the highest cosine above 0; ``skips``: an example to leave out."""
        near, read = self.sums(vectors, k, skips)
        n, out = len(self.ids), []
        near[~np.repeat(read, BLOCK, 1)[:, :n]] = 0
        least = np.maximum(np.partition(near, n - k, 1)[:, n - k], 0) if n > k else np.zeros(len(vectors))
        near_enough = (near > 0) & (near >= least[:, None] - LOST)
        own = np.zeros(len(self.terms))
        for j, (at, w) in enumerate(vectors):
            i = np.flatnonzero(near_enough[j])
            if not len(i):
                out.append((i, np.zeros(0), np.zeros(0)))
                continue
            own[at] = w
            lo, hi = self.ends[i], self.ends[i + 1]
            q, first = spans(lo, hi), np.cumsum(hi - lo) - (hi - lo)
            term = self.of[q]
            x = own[term] * self.x[q]
            s, t = np.add.reduceat(x, first), np.add.reduceat(x * self.factor[term], first)
            own[at] = 0
            order = np.lexsort((self.ids[i], -s))[:k]
            out.append((i[order], s[order], t[order]))
        return out

    def votes(self, texts: list, share: float, skips: list | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """(toxic share of the votes, places, cosines, votes) of each text."""
        ones = max(1.0, float(self.labels.sum()))
        n = len(self.ids)
        # what a vote of a label counts, so that the sample's labels weigh as in the whole
        weigh = np.where(self.labels > 0, share / ones, (1 - share) / max(1.0, n - ones)) * n
        ends, at, k = counted(self.terms, texts)
        for few in _together(texts, TOGETHER, TOGETHER_CHARS):
            own = [slice(a, b) for a, b in zip(ends[few], ends[few.start + 1 : few.stop + 1], strict=True)]
            for i, s, told in self.nearest([(at[o], self.vector(at[o], k[o])) for o in own], skips=skips and skips[few]):
                vote = s / (1.05 - np.minimum(s, 1.0)) * (told / s) ** 2 * weigh[i]
                yield (float((vote * self.labels[i]).sum()) + PRIOR_VOTES * share) / (float(vote.sum()) + PRIOR_VOTES), i, s, vote


class Model:
    """Where the index is, the share of toxic labels, and the curve of the scores. A few numbers; the index stays in its folder."""

    def __init__(self, root: str | None, share: float, curve: tuple[float, float] = (1.0, 0.0)):
        self.root, self.share, self.curve = root, share, curve

    def index(self) -> Index:
        return kept(self.root, lambda: Index(self.root))

    def scored(self, texts: list) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """(calibrated score, evidence: ids, cosines and labels, strongest vote first) of each text."""
        if self.root is None:
            yield from ((self.share, *([np.zeros(0)] * 3)) for _ in texts)
            return
        (a, b), index = self.curve, self.index()
        for p, i, s, vote in index.votes(texts, self.share):
            first = np.argsort(-vote, kind="stable")[:EVIDENCE]
            yield float(1 / (1 + np.exp(-(a * _logit(p) + b)))), index.ids[i[first]], s[first], index.labels[i[first]]

    def score(self, text: str | None) -> tuple[float, list[tuple]]:
        p, *evidence = next(self.scored([text]))
        return p, list(zip(*(e.tolist() for e in evidence), strict=True))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _logistic(odds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted, slightly damped logistic fit on the votes' log odds."""
    x, theta = np.stack((odds, np.ones(len(odds))), 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (weights * (labels - p)) - 0.1 * (theta - [1.0, 0.0]))
        theta = theta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fold(id_col) -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows outside fold 0; document frequencies cover all of ``docs``."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    marked = marked.where(fold(F.col("id")) != 0)
    n, share = marked.agg(F.count("*"), F.avg("y")).first()
    if not n:
        return Model(None, 0.0)
    order = [F.xxhash64("id"), F.col("id")]
    picked = marked.where("y = 1").orderBy(*order).limit(SAMPLE_PER_CLASS).unionByName(marked.where("y = 0").orderBy(*order).limit(SAMPLE_PER_CLASS))
    # at most 2 * SAMPLE_PER_CLASS ids: small on every input; of an id with several texts the one of the lowest hash
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    texts = texts.groupBy("id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")).groupBy("text").agg(F.min("id").alias("id"), F.max("y").alias("y"))
    texts = settle(texts.select("id", "y", "text").coalesce(SAMPLE_PARTITIONS), "toxic-sample")
    sizes = {r["y"]: float(r["count"]) for r in texts.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model(None, float(share))
    root = scratch_path(docs.sparkSession, "toxic-index")

    def used(batches):
        for part in pieces(batches, TOGETHER):
            for i, y, text in zip(*(part.column(c).to_pylist() for c in ("id", "y", "text")), strict=True):
                seen = terms_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(seen), pa.int64()), pa.array([y] * len(seen), pa.int32()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["id", "y", "term", "tf"])

    uses = settle(texts.mapInArrow(used, "id long, y int, term string, tf long"), "toxic-uses")
    p, q = F.sum("y").cast("double") / sizes[1], F.sum(1 - F.col("y")).cast("double") / sizes[0]
    both = F.count("*") / (sizes[1] + sizes[0])
    spread = F.sqrt(both * (1 - both) * (1 / sizes[1] + 1 / sizes[0]))
    vocabulary = uses.groupBy("term").agg(F.when(both < 1, (p - q) / spread).otherwise(0.0).alias("z"))
    # ranges of terms, sorted: numbers rise with the terms, however the ranges are cut
    vocabulary = _written(vocabulary.repartitionByRange("term").sortWithinPartitions("term").withColumn("number", F.monotonically_increasing_id()), f"{root}/vocabulary")

    def frequencies(batches):
        def read():
            terms = _read(f"{root}/vocabulary", ["number", "term"])
            return _numbers(terms), terms.column("number").to_numpy()

        known, numbers = kept(f"{root}/vocabulary", read)
        seen, rows = np.zeros(len(numbers), np.int64), 0
        for part in pieces(batches, COUNTED):
            batch_texts = part.column("text").to_pylist()
            for few in _together(batch_texts, COUNTED, COUNTED_CHARS):
                at = counted(known, batch_texts[few])[1]
                seen += np.bincount(at, minlength=len(seen))
            rows += len(batch_texts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(numbers[at], -1), pa.int64()), pa.array(np.append(seen[at], rows))], names=["number", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(frequencies, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    found = settle(found, "toxic-frequencies")
    total = found.where("number = -1").first()["n"]
    z = F.col("z")
    weights = vocabulary.join(found, "number", "left").select(
        "number",
        "term",
        (F.log(F.lit(total + 1.0) / (F.coalesce("n", F.lit(0)) + 1)) + 1).alias("idf"),
        ((z * z + LEAST * HALF_Z**2) / (z * z + HALF_Z**2)).alias("factor"),
    )
    weights = _written(weights.repartitionByRange("number").sortWithinPartitions("number"), f"{root}/terms")

    rows = uses.join(weights.select("number", "term", "idf"), "term").select("id", "y", "tf", "number", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    # an example's terms are summed in their order, so the same bits come out of every run
    by_term = F.array_sort(F.collect_list(F.struct("number", "w")))
    kinds = rows.groupBy("id").agg(
        F.max("y").alias("y"),
        F.sqrt(F.aggregate(by_term, F.lit(0.0), lambda s, x: s + x["w"] * x["w"])).alias("norm"),
        F.max(F.struct("tf", "number"))["number"].alias("commonest"),
        F.max(F.struct("w", "number"))["number"].alias("heaviest"),
    )
    known = texts.select("id", "y").join(kinds.drop("y"), "id", "left")
    # one row an example: bounded by the sample
    near = Window.orderBy("commonest", "heaviest", "id")
    examples = _written(known.withColumn("place", F.row_number().over(near) - 1), f"{root}/examples")
    entries = rows.join(examples.select("id", "place", "norm"), "id").select("number", "place", (F.col("w") / F.col("norm")).alias("x"))
    held = F.array_sort(F.collect_list(F.struct("place", "x")))
    blocks = entries.groupBy("number", F.floor(F.col("place") / BLOCK).cast("int").alias("block")).agg(F.max("x").alias("best"), held.alias("held"))
    blocks = blocks.select("number", "block", "best", F.col("held.place").alias("places"), F.col("held.x").alias("weights"))
    _written(blocks.repartitionByRange("number").sortWithinPartitions("number", "block"), f"{root}/blocks")

    model = Model(root, float(share))

    def left_out(batches):
        index = model.index()
        for part in pieces(batches, TOGETHER):
            own, y = part.column("place").to_pylist(), part.column("y")
            votes = [v[0] for v in index.votes(part.column("text").to_pylist(), model.share, own)]
            yield pa.RecordBatch.from_arrays([y, pa.array(np.rint(_logit(np.array(votes)) / STEP).astype(np.int64))], names=["y", "at"])

    asked = texts.join(examples.select("id", "place"), "id").select("place", "y", "text").repartition(SAMPLE_PARTITIONS, "place")
    votes = asked.mapInArrow(left_out, "y int, at long").groupBy("y", "at").count().orderBy("y", "at").collect()
    y, at, times = (np.array([r[k] for r in votes], np.float64) for k in range(3))
    weigh = np.where(y > 0, share / sizes[1], (1 - share) / sizes[0]) * (sizes[1] + sizes[0])
    model.curve = _logistic(at * STEP, y, weigh * times)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out``: score, predicted (score >= 0.5) and evidence (doc_id, cosine, label).

    Only the texts go to Python, and only scores come back.
    """
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))])

    # only the folder's name and a few numbers go along with the tasks
    @F.arrow_udf("struct<score:double,predicted:int,evidence:array<struct<doc_id:bigint,cosine:double,label:int>>>")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = []
            for at in range(0, len(column), COUNTED):
                few = column.slice(at, COUNTED).to_pylist()
                made = list(chain.from_iterable(model.scored(few[part]) for part in _together(few, COUNTED, COUNTED_CHARS)))
                score = np.array([m[0] for m in made])
                ids, cosines, labels = (np.concatenate([m[k] for m in made]) for k in (1, 2, 3))
                evidence = pa.StructArray.from_arrays([pa.array(ids.astype(np.int64)), pa.array(cosines, pa.float64()), pa.array(labels.astype(np.int32))], names=["doc_id", "cosine", "label"])
                ends = np.cumsum([0, *(len(m[1]) for m in made)])
                parts.append(pa.StructArray.from_arrays([pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), evidence)], names=["score", "predicted", "evidence"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return docs.withColumn(out, scored(F.col(f"`{text_col}`")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "toxicity.score", "toxicity.predicted", F.transform("toxicity.evidence", lambda e: e["doc_id"]).alias("evidence_doc_ids"), "toxicity.evidence")


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
