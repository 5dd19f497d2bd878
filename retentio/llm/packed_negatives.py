"""Hard-negative mining on Kronecker-packed products.

Vectors become whole numbers, ``floor(scale * x)`` of each component. Scores are
exact inner products. To get the scores of several candidates from one product,
their components, biased to be no less than zero, are written into separated
fields of one wide integer, candidate k at bit ``k * width``. An anchor component,
biased as well, multiplies that integer once; the sum over the components holds
each candidate's biased score in its own field, because ``width`` bits are enough
for the largest possible sum. Fields are unpacked with shifts and masks, and the
biases taken off: with q + b and a + c in the fields, q.a is the field less
c * sum(q), b * sum(a) and d * b * c.

The width follows from the largest components of the table. As long as all fields
stay below 2**53 the wide integers are carried in float64, which holds such
integers exactly, so that a matrix product does the multiplications; with larger
components (one field would need more) they are Python integers of
``LONG_FIELDS`` fields. A score beyond 64 bits is an error.

Rows take part if id-independent parts are there: the label is not null and the
vector neither is null nor has a null or non-finite component. They are written once,
in files of ranges of (label, id); the anchors, a stated share of the ids, are
written in files of about ``ANCHORS``. A task takes one file of anchors and one of
candidates, reads both from the shared folder in batches, and keeps for each
anchor only its best rows; tasks' results meet in a grouped top-k of a few rows
a file. So the work is anchors times rows, in blocks, and no task holds more
than a batch. First pass: the best rows of the anchor's label, its positives. Second
pass: for each positive the best rows of other labels in its score window.

Defined results: shorter vectors end in zeros; a row whose id equals the anchor's
is the anchor, never its positive or negative; anchors equal in id, label and
vector are one; other repeated rows are candidates of their own; equal scores are
ordered by id, null ids last; a null id is never an anchor; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import files_of, output_root, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Vectors that are multiplied at once, and anchors that a task holds.
BLOCK, ANCHORS = 4096, 1024
#: Bits that a float64 holds exactly; fields of a Python integer.
EXACT_BITS, LONG_FIELDS = 53, 64
NULL_ID = np.iinfo(np.int64).max


def whole_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """Rows that take part: id, label, q (array of long), all finite."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False)))
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), q.alias("q"))


def packing(low: int, high: int, dims: int) -> tuple[int, int, bool]:
    """(bits of a field, fields of a wide integer, whether they are carried in float64) for components in [low, high]."""
    width = max(1, (dims * (high - low) ** 2).bit_length())
    short = EXACT_BITS // width
    return (width, short, True) if short else (width, LONG_FIELDS, False)


class Packed:
    """Candidate vectors (n x d) as wide integers, ready to be multiplied with anchors."""

    def __init__(self, q: np.ndarray, low: int, high: int):
        self.n, self.d = q.shape
        self.low = low
        self.width, self.fields, self.short = packing(low, high, self.d)
        groups = -(-self.n // self.fields)
        biased = q - low
        if self.short:
            padded = np.zeros((groups * self.fields, self.d), np.int64)
            padded[: self.n] = biased
            lanes = padded.reshape(groups, self.fields, self.d) << (np.arange(self.fields, dtype=np.int64) * self.width)[None, :, None]
            self.wide = lanes.sum(axis=1).astype(np.float64).T.copy()  # d x groups
        else:
            shifts = [k * self.width for k in range(self.fields)]
            self.wide = np.array([[sum(int(v) << s for v, s in zip(biased[g * self.fields : (g + 1) * self.fields, j], shifts)) for g in range(groups)] for j in range(self.d)], object).reshape(self.d, groups)
        #: What the biases add to a candidate's field, less the anchor's share.
        self.sums = q.sum(axis=1)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors x candidates, as int64."""
        low, d = self.low, self.d
        biased = anchors - low
        if self.short:
            made = (biased.astype(np.float64) @ self.wide).astype(np.int64)
            mask = (1 << self.width) - 1
            fields = np.stack([(made >> (k * self.width)) & mask for k in range(self.fields)], axis=2).reshape(len(anchors), -1)[:, : self.n]
        else:
            mask = (1 << self.width) - 1
            made = biased.astype(object) @ self.wide
            fields = np.array([[(int(v) >> (k * self.width)) & mask for v in row for k in range(self.fields)][: self.n] for row in made], object).reshape(len(anchors), self.n)
        # field = sum (q - low)(a - low)
        return (fields + low * (self.sums[None, :] + anchors.sum(axis=1)[:, None]) - d * low * low).astype(np.int64)


def vectors_of(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as a matrix; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dims), np.int64)
    flat = np.asarray(column.flatten())
    if len(column) and lengths.min() == dims and lengths.max() == dims:
        return flat.reshape(len(column), dims)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def batches_of(root: str, k: int, size: int, dims: int):
    """Of the k-th file: batches of at most ``size`` rows, ordered by id inside; (table, ids, labels, vectors)."""
    fs, files = files_of(root)
    if k >= len(files):
        return
    with fs.open_input_file(files[k]) as f:
        for part in pq.ParquetFile(f).iter_batches(batch_size=size):
            ids = np.asarray(part.column("id").fill_null(NULL_ID))
            order = np.argsort(ids, kind="stable")
            part = part.take(pa.array(order))
            yield part, ids[order], np.asarray(part.column("label")), vectors_of(part.column("q"), dims)


def keys_of(scores: np.ndarray) -> np.ndarray:
    """Keys that order a row's candidates by score, then by place: larger is better, and all are at least 0."""
    n = scores.shape[1]
    low, high = int(scores.min()), int(scores.max())
    if (high - low + 1) * n < 1 << 62:
        ranks = scores - low
    else:  # too wide for one long: their ranks
        ranks = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    return ranks * n + (n - 1 - np.arange(n))[None, :]


class Best:
    """The best ``k`` (score, id) of each of ``n`` queries so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.zeros((n, k), np.int64)
        self.ids = np.zeros((n, k), np.int64)
        self.there = np.zeros((n, k), bool)

    def add(self, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Candidates (columns, with ``ids``) of the queries ``rows``, where ``allowed``."""
        keys = np.where(allowed, keys, -1)
        k = min(self.k, keys.shape[1])
        top = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:]
        there = np.concatenate([self.there[rows], np.take_along_axis(keys, top, 1) >= 0], axis=1)
        found = np.concatenate([self.scores[rows], np.take_along_axis(scores, top, 1)], axis=1)
        names = np.concatenate([self.ids[rows], ids[top]], axis=1)
        order = np.lexsort((names, -found, ~there), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows], self.there[rows] = (np.take_along_axis(v, order, 1) for v in (found, names, there))


def _pairs(spark: SparkSession, anchors: int, files: int) -> DataFrame:
    """A task for each pair of an anchor file and a candidate file."""
    return spark.range(0, anchors * files, 1, anchors * files)


FOUND = pa.schema([("a", pa.int64()), ("p", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def _found(a: np.ndarray, p: int, best: Best) -> pa.RecordBatch:
    rows, cols = np.nonzero(best.there)
    ids = best.ids[rows, cols]
    return pa.RecordBatch.from_arrays([pa.array(a[rows]), pa.array(np.full(len(rows), p, np.int32)), pa.array(best.scores[rows, cols]), pa.array(ids, mask=ids == NULL_ID)], schema=FOUND)


def window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores s with low * positive <= 100 * s <= high * positive, as bounds; no product leaves 64 bits."""
    whole, rest = positive // 100, positive % 100
    return whole * low - (-rest * low) // 100, whole * high + (rest * high) // 100


def _search(spark: SparkSession, anchors: str, candidates: str, counts: tuple[int, int], dims: int, low: int, high: int, k: int, share: tuple[int, int] | None) -> DataFrame:
    """(a, p, score, id): per anchor of the file table the best of its label (``share`` None, p = 0), or per
    positive p the best of other labels whose scores are within ``share`` hundredths of the positive's."""
    n_anchors, n_files = counts

    def run(parts):
        for part in parts:
            for number in part.column("id").to_pylist():
                for table_, own, labels, vectors in batches_of(anchors, number // n_files, ANCHORS, dims):
                    a = np.asarray(table_.column("a"))
                    if share is None:
                        searches = [Best(len(a), k)]
                    else:
                        positives = table_.column("scores").to_pylist()
                        searches = [Best(len(a), k) for _ in range(max(map(len, positives), default=0))]
                        held = [np.array([p < len(x) for x in positives]) for p in range(len(searches))]
                        bounds = [window(np.array([x[p] if p < len(x) else 0 for x in positives], np.int64), *share) for p in range(len(searches))]
                    for _, ids, kinds, q in batches_of(candidates, number % n_files, BLOCK, dims):
                        if share is None:
                            for label in np.intersect1d(labels, kinds):
                                rows, cols = np.flatnonzero(labels == label), np.flatnonzero(kinds == label)
                                scores = Packed(q[cols], low, high).scores(vectors[rows])
                                searches[0].add(rows, scores, keys_of(scores), ids[cols], ids[cols][None, :] != own[rows, None])
                            continue
                        scores = Packed(q, low, high).scores(vectors)
                        keys = keys_of(scores)
                        other = (kinds[None, :] != labels[:, None]) & (ids[None, :] != own[:, None])
                        for p, best in enumerate(searches):
                            least, most = bounds[p]
                            allowed = other & (scores >= least[:, None]) & (scores <= most[:, None]) & held[p][:, None]
                            rows = np.flatnonzero(allowed.any(axis=1))
                            if len(rows):
                                best.add(rows, scores[rows], keys[rows], ids, allowed[rows])
                    for p, best in enumerate(searches):
                        yield _found(a, p, best)

    return _pairs(spark, n_anchors, n_files).mapInArrow(run, "a long, p int, score long, id long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """(a, p, best: the first k of (score, id), best first); a group has at most k rows of each candidate file."""
    order = F.struct((-F.col("score")).alias("down"), F.col("id").isNull().alias("none"), "id")
    return found.groupBy("a", "p").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (50, 95), scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; ``share`` are the hundredths of the
    positive's score between which a negative's lies.
    """
    spark = vectors.sparkSession
    rows = whole_rows(vectors, id_col, vector_col, label_col, scale)
    # every write names its own folder; the driver sees sizes only
    root = output_root(spark, "negatives")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "label", "id", F.monotonically_increasing_id()).sortWithinPartitions("label", "id").write.parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")
    is_anchor = F.col("id") % every == 0
    n, n_anchors, dims, low, high = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("q")), F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    made = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not n_anchors:
        return spark.createDataFrame([], made)
    dims, low, high = max(1, dims), min(low or 0, 0), max(high or 0, 0)  # shorter vectors end in zeros
    if dims * max(-low, high) ** 2 >= 1 << 63:
        raise ValueError(f"{dims} components of up to {max(-low, high)} give scores beyond 64 bits")
    anchors = rows.where(is_anchor).dropDuplicates(["id", "label", "q"]).withColumn("a", F.monotonically_increasing_id())
    anchor_files = -(-n_anchors // ANCHORS)
    anchors.repartitionByRange(anchor_files, "label", "id", "a").write.parquet(f"{root}/anchors")
    counts = (anchor_files, parts)
    near = _search(spark, f"{root}/anchors", f"{root}/rows", counts, dims, low, high, positives, None)
    best = _top(near, positives).select("a", F.transform("best", lambda b: -b["down"]).alias("scores"), F.transform("best", lambda b: b["id"]).alias("ids"))
    with_positives = spark.read.parquet(f"{root}/anchors").join(best, "a")
    with_positives.repartitionByRange(anchor_files, "label", "id", "a").write.parquet(f"{root}/positives")
    far = _search(spark, f"{root}/positives", f"{root}/rows", counts, dims, low, high, negatives, share)
    ranked = _top(far, negatives).select("a", "p", F.posexplode("best").alias("place", "b"))
    pairs = spark.read.parquet(f"{root}/positives").select("a", F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("p", "x"))
    return pairs.join(ranked, ["a", "p"]).select("anchor_id", F.col("x.ids").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"), F.col("x.scores").alias("positive_score"), (-F.col("b.down")).alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


QUERIES = {"op11_hard_negatives": op11_hard_negatives}

SQL = {
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.anchor_label
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""
}
