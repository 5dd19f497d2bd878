r"""Prefix trie of conversations, screened by a count-min sketch.

A conversation's first d turns are named by a digest: the hash of each turn's
role, text and place is split into four numbers of 32 bits, whose running sums
name the prefix. Sums can be carried, so a conversation that holds a third of
all turns is dealt to many tasks: a range partitioning by (conversation, place),
running sums inside each task, and a carry for the at most one conversation that
reaches from one task into the next (``running``).

Most prefixes belong to one conversation. All prefix digests are counted in a
count-min sketch of ``SKETCH_ROWS`` rows, of which only one bit a cell is kept:
whether it counted just one prefix. If any cell of a prefix did, the estimate
one proves that it is a singleton, and so are its continuations: their nodes are
emitted where they are. Only possibly shared prefixes, and the first turn behind
one, are shuffled and grouped exactly by digest. A wrong "possibly" costs a row
in the shuffle and nothing else. The width is four times the prefixes, at most
``MAX_WIDTH``, which bounds what a task reads of it (``SKETCH_ROWS * MAX_WIDTH / 8``
bytes); above a fourth of that many prefixes the sketch fills up, and more prefixes are
grouped exactly.

Sums over a node's subtree need no walk: every node below it lies on the paths
of its members, so values put on the members' rows (a turn's words for each
member that is not its node's first, one for each childless node at its first
member) are summed along each conversation from its end and then over the
node's members.

``rebuild`` replaces the first turns of conversations by those of another one,
as a corpus with shared openings has them; ``trie`` takes any rows of
(conv_id, depth, unit, words, is_end).

Defined results: null turns come first, turns of equal number are ordered by role,
then by the text's MD5; null roles and texts are empty; rows of a null
conv_id take no part; repeated rows are turns of their own; a conversation
without turns is a member of the root; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import files_of, output_root, settle, table

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the sketch, least and largest width (powers of two), cells of a stored block.
SKETCH_ROWS, MIN_WIDTH, MAX_WIDTH, BLOCK = 3, 1 << 16, 1 << 26, 1 << 16
#: Ids of one piece of a node's list of ends.
PIECE = 8192
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(rows: DataFrame, order: list, values: list[str], name: str) -> DataFrame:
    """``rows`` with ``run_<value>``: running sums of non-negative longs within conv_id in the given order.

    Neighbours meet by a range partitioning of (conv_id, order); every task sums
    its own rows, and conversations that reach over tasks get the sums of the
    tasks before. The driver sees at most two rows a task.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(_parts(spark), "conv_id", *order).sortWithinPartitions("conv_id", *order)

    def run(batches):
        task, last, carry = TaskContext.get().partitionId(), None, np.zeros(len(values), np.int64)
        for part in batches:
            if not part.num_rows:
                continue
            conv = np.asarray(part.column("conv_id"))
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            first_rows = np.repeat(starts, np.diff(np.append(starts, len(conv))))
            sums = []
            for k, value in enumerate(values):
                v = np.asarray(part.column(value))
                total = np.cumsum(v)
                total -= (total - v)[first_rows]
                if last is not None and conv[0] == last:
                    total[: starts[1] if len(starts) > 1 else len(conv)] += carry[k]
                sums.append(total)
            last, carry = conv[-1], np.array([s[-1] for s in sums], np.int64)
            extra = [pa.array(s) for s in sums] + [pa.array(np.full(len(conv), task, np.int32))]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, *(f"run_{v}" for v in values), "_task"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"run_{v} long" for v in values] + ["_task int"])
    done = settle(ordered.mapInArrow(run, schema), name)
    ends = done.groupBy("_task").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).orderBy("_task").collect()
    over = sorted({a.high for a, b in zip(ends, ends[1:]) if a.high == b.low})
    if not over:
        return done.drop("_task")
    wide = F.broadcast(spark.createDataFrame([(c,) for c in over], "conv_id long"))  # at most one a task
    sums = [F.max(f"run_{v}").alias(f"run_{v}") for v in values]
    totals = done.join(wide, "conv_id", "left_semi").groupBy("conv_id", "_task").agg(*sums).orderBy("conv_id", "_task").collect()
    carries, before = [], {}
    for row in totals:
        carried = before.get(row.conv_id, [0] * len(values))
        carries.append((row.conv_id, row._task, *carried))
        before[row.conv_id] = [c + row[f"run_{v}"] for c, v in zip(carried, values, strict=True)]
    # at most two rows a task
    carried = F.broadcast(spark.createDataFrame(carries, "conv_id long, _task int, " + ", ".join(f"c_{v} long" for v in values)))
    joined = done.join(carried, ["conv_id", "_task"], "left")
    added = {f"run_{v}": F.col(f"run_{v}") + F.coalesce(F.col(f"c_{v}"), F.lit(0)) for v in values}
    return joined.withColumns(added).drop("_task", *(f"c_{v}" for v in values))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), unit (a digest of role and text), words: the texts themselves go no further."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("text_md5"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("unit"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("place"), F.monotonically_increasing_id().alias("row"))
    return running(rows, ["turn", "role", "text_md5", "row"], ["place"], "trie-turns").select("conv_id", F.col("run_place").alias("place"), "unit", "words")


def rebuild(own: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, length; rebuilt turns: conv_id, depth, unit, words, is_end).

    Conversation c gets the first h = crc32(c) % (most + 1) turns of conversation
    c - c % group, then its own turns after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h")
    counts = settle(own.groupBy("conv_id").agg(F.count("*").alias("n")), "trie-counts")
    base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = counts.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(base, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = settle(convs.select("conv_id", "n", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    # at most ``most`` turns of each base, for at most twice ``group`` conversations
    heads = own.where((F.col("place") <= most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    opened = convs.join(heads, "base").where("place <= h").select("conv_id", F.col("place").alias("depth"), "unit", "words", (F.col("place") == F.col("length")).alias("is_end"))
    depth = F.col("place") - F.col("h") + F.col("taken")
    rest = own.join(convs, "conv_id").where("place > h").select("conv_id", depth.alias("depth"), "unit", "words", (depth == F.col("length")).alias("is_end"))
    return convs.select("conv_id", "length"), opened.union(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, words, is_end, digest and parent (digests of the first depth and depth - 1 turns)."""
    hashed = rows.withColumn("at", F.md5(F.concat_ws(":", "depth", "unit")))
    numbers = [F.conv(F.substring("at", 8 * k + 1, 8), 16, 10).cast("long").alias(f"u{k}") for k in range(4)]
    names = [f"u{k}" for k in range(4)]
    summed = running(hashed.select("conv_id", "depth", "words", "is_end", *numbers), ["depth"], names, "trie-sums")
    digest = F.unhex(F.md5(F.concat_ws(":", "depth", *(f"run_{n}" for n in names))))
    parent = F.unhex(F.md5(F.concat_ws(":", F.col("depth") - 1, *(F.col(f"run_{n}") - F.col(n) for n in names))))
    return settle(summed.select("conv_id", "depth", "words", "is_end", digest.alias("digest"), parent.alias("parent")), "trie-prefixes")


def width_of(n: int, most: int = MAX_WIDTH) -> int:
    """The power of two of at least four times ``n``, between ``MIN_WIDTH`` and ``most``."""
    return min(most, max(MIN_WIDTH, 1 << (4 * max(1, n) - 1).bit_length()))


def cells_of(column: pa.Array, width: int) -> np.ndarray:
    """Cells (rows of the sketch x digests) of binary digests of 16 bytes."""
    words = np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, 4)
    return np.stack([(words[:, r].astype(np.int64) & (width - 1)) + r * width for r in range(SKETCH_ROWS)])


def sketch(found: DataFrame, width: int, root: str) -> None:
    """Write the count-min sketch of ``digest`` to ``root``: (block, bits), a bit for each cell that counted just one."""

    def count(batches):
        block, cell, twice = [], [], []

        def out():
            cells = np.concatenate(cell)
            named, many = np.unique(cells, return_counts=True)
            blocks, at = np.unique(named // BLOCK, return_index=True)
            for b, cs, ns in zip(blocks.tolist(), np.split((named % BLOCK).astype("<u2"), at[1:]), np.split(many > 1, at[1:]), strict=True):
                block.append(b)
                twice.append((cs[~ns].tobytes(), cs[ns].tobytes()))
            made = pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([t[0] for t in twice], pa.binary()), pa.array([t[1] for t in twice], pa.binary())], names=["block", "once", "more"])
            block.clear(), cell.clear(), twice.clear()
            return made

        held = 0
        for part in batches:
            if part.num_rows:
                cell.append(cells_of(part.column("digest"), width).ravel())
                held += cell[-1].size
            if held >= 1 << 20:
                yield out()
                held = 0
        if cell:
            yield out()

    def merge(batches):
        now, counts = None, np.zeros(BLOCK, np.uint8)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(counts == 1).tobytes()], pa.binary())], names=["block", "bits"])

        for part in batches:
            for b, once, more in zip(*(part.column(c).to_pylist() for c in ("block", "once", "more")), strict=True):
                if b != now:
                    if now is not None:
                        yield out()
                    now, counts = b, np.zeros(BLOCK, np.uint8)
                cs = np.frombuffer(once, "<u2")
                counts[cs] = np.minimum(counts[cs] + 1, 2)
                counts[np.frombuffer(more, "<u2")] = 2
        if now is not None:
            yield out()

    partial = found.select("digest").mapInArrow(count, "block long, once binary, more binary")
    partial.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary").write.parquet(root)


def screen(found: DataFrame, width: int, root: str) -> DataFrame:
    """``found`` with ``tail``: the sketch proves that the prefix one turn shorter is a singleton."""

    def run(batches):
        bits = np.zeros(SKETCH_ROWS * width // 8, np.uint8)
        fs, files = files_of(root)
        for name in files:
            with fs.open_input_file(name) as f:
                for part in pq.ParquetFile(f).iter_batches(batch_size=256):
                    for b, held in zip(part.column("block").to_pylist(), part.column("bits").to_pylist(), strict=True):
                        bits[b * BLOCK // 8 : (b + 1) * BLOCK // 8] = np.frombuffer(held, np.uint8)
        for part in batches:
            if part.num_rows:
                cells = cells_of(part.column("parent"), width)
                single = ((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).any(axis=0)
                # the root is no prefix of the sketch
                tail = single & (np.asarray(part.column("depth")) > 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tail)], names=[*part.schema.names, "tail"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInArrow(run, schema + ", tail boolean")


def ends(members: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the ids (digest, conv_id) in ascending order, comma-joined.

    Ids are sorted by a range partitioning, so a node where very many end is
    sorted by many tasks; its hash then runs over long pieces.
    """

    def piece(batches):
        task, now, ids, k = TaskContext.get().partitionId(), None, [], 0
        for part in batches:
            out = []
            for digest, conv_id in zip(part.column("digest").to_pylist(), part.column("conv_id").to_pylist(), strict=True):
                if ids and (digest != now or len(ids) == PIECE):
                    out.append((now, task, k, ",".join(map(str, ids))))
                    ids, k = [], k + 1
                now = digest
                ids.append(conv_id)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["digest", "task", "k", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([task], pa.int32()), pa.array([k], pa.int64()), pa.array([",".join(map(str, ids))])], names=["digest", "task", "k", "ids"])

    def hashed(batches):
        now, state = None, None
        for part in batches:
            out = []
            for digest, ids in zip(part.column("digest").to_pylist(), part.column("ids").to_pylist(), strict=True):
                if digest != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], names=["digest", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])

    n = _parts(members.sparkSession)
    pieced = members.repartitionByRange(n, "digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(piece, "digest binary, task int, k long, ids string")
    return pieced.repartition(F.col("digest")).sortWithinPartitions("digest", "task", "k").mapInArrow(hashed, "digest binary, ends_sha256 string")


def trie(convs: DataFrame, rows: DataFrame, max_width: int = MAX_WIDTH) -> DataFrame:
    """Nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs``: conv_id, length. ``rows``: conv_id, depth, unit, words, is_end.
    """
    spark = rows.sparkSession
    found = prefixes(rows)
    width, root = width_of(found.count(), max_width), output_root(spark, "trie-sketch")
    sketch(found, width, root)
    screened = settle(screen(found, width, root), "trie-screened")
    alone = F.when(F.col("is_end"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA))
    tails = screened.where("tail").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("is_end"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), alone.alias("ends_sha256"))

    shared = screened.where("NOT tail")
    nodes = shared.groupBy("digest", "parent", "depth").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.count_if("is_end").alias("n_ends"))
    nodes = settle(nodes, "trie-nodes")
    above = nodes.select(F.col("digest").alias("parent"), F.col("first").alias("parent_first"), F.col("n").alias("parent_n"))
    nodes = settle(nodes.join(above, "parent", "left"), "trie-linked")
    # a node's own words count for every member but its first; a childless node counts at its first member
    names = nodes.select("digest", "first", "n", "n_ends", "parent_n")
    own = shared.join(names, "digest")
    parted = (F.col("n") == 1) & ((F.col("depth") == 1) | (F.col("parent_n") > 1))
    childless = F.col("is_end") & (F.col("n") > 1) & (F.col("n") == F.col("n_ends")) & (F.col("first") == F.col("conv_id"))
    valued = own.select("conv_id", "digest", (-F.col("depth")).alias("up"), F.when(F.col("first") == F.col("conv_id"), 0).otherwise(F.col("words")).cast("long").alias("saved"), F.when(F.coalesce(parted, F.lit(False)) | childless, 1).otherwise(0).cast("long").alias("leaf"))
    below = running(valued, ["up"], ["saved", "leaf"], "trie-below").groupBy("digest").agg(F.sum("run_saved").alias("saved_tokens"), F.sum("run_leaf").alias("n_leaves"))
    children = nodes.groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    listed = ends(shared.where("is_end").select("digest", "conv_id"))
    lone = F.when(F.col("n") == 1, 1 - F.col("n_ends")).otherwise(F.coalesce("n_children", F.lit(0)))
    inner = settle(
        nodes.join(below, "digest").join(children, "digest", "left").join(listed, "digest", "left").select(
            F.col("first").alias("conv_id"), "depth", F.when(F.col("depth") > 1, F.coalesce("parent_first", "first")).alias("parent_conv_id"), F.col("n").alias("n_convs"), lone.cast("long").alias("n_children"),
            # a singleton's one childless node may be counted above it, at the first singleton of its path
            F.when(F.col("n") == 1, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")), "trie-inner")

    members = convs.agg(F.min("conv_id").alias("first"), F.count("*").alias("n"))
    top = inner.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    none = ends(convs.where("length = 0").select(F.lit(b"").alias("digest"), "conv_id")).agg(F.max("ends_sha256").alias("ends_sha256"))
    # aggregates of one row each
    base = members.join(F.broadcast(top)).join(F.broadcast(none)).where("n > 0").select(
        F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.greatest(F.coalesce("n_leaves", F.lit(1)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    first = F.broadcast(members.select(F.col("first").alias("_root")))  # one row
    linked = inner.join(first).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_root")).drop("_root")
    return base.unionByName(linked).unionByName(tails)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuild(turns(table(spark, sf_dir, "conversations"))))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}

SQL = {
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS j
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
           lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)),
           4294967295), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id),
k AS (
  SELECT c.conv_id, c.n, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken
  FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT k.conv_id, j AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND j <= h
  UNION ALL
  SELECT k.conv_id, j - h + taken, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND j > h),
p AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(md5(len(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM k),
e AS (
  SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(key, depth) AS key FROM p GROUP BY conv_id) GROUP BY key),
g AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(words) AS saved
  FROM p GROUP BY key, depth),
q AS (
  SELECT g.*, (SELECT count(*) FROM g b WHERE b.depth = g.depth + 1 AND starts_with(b.key, g.key)) AS n_children FROM g),
u AS (
  SELECT a.key, CAST(count(*) FILTER (b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens
  FROM q a JOIN q b ON b.depth >= a.depth AND starts_with(b.key, a.key) GROUP BY a.key)
SELECT q.conv_id, CAST(q.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, q.n AS n_convs, q.n_children,
       u.n_leaves, u.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM q JOIN u ON u.key = q.key LEFT JOIN e ON e.key = q.key
LEFT JOIN q a ON a.depth = q.depth - 1 AND starts_with(q.key, a.key)
"""
}
