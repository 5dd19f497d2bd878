"""Mixing sources to target weights by hash-threshold histograms.

Sizes are words. Sources, ordered by code point with null last, weigh 5, 2, 1,
repeating, and share the words of all sources; a target stops at three times
its source's size and the excess is shared again by weight. A source whose
target is q times its size takes every document floor(q) times and, in the
order of a hash of each document, the first documents once more until the rest
of the target is filled.

The end of that order is found without sorting documents: words are summed by
source and hash bucket, the bucket holding the end is cut into finer buckets,
and so on for ``LEVELS`` levels. The last boundary bucket (equal hash prefixes)
is in effect one document, taken if that brings the sum nearer. Rows equal in
doc_id and text fall into it together: then as many of its rows are taken as come
nearest, by a running number inside that bucket (written once, numbered in its
tasks, with the tasks' counts before). Every bucket sum is at most 16**DIGITS
rows a source, so a source with a third of all rows costs no more than others.
The result depends on rows only (of equal rows, any may be the taken ones), so
reruns agree.

Defined results: a null text has size 0; null is a source of its own; rows
equal in doc_id and text differ by at most one copy; an empty table gives no rows. Other
columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.llm.common import settle, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Hash digits read at each level, and levels: 48 bits in all.
DIGITS, LEVELS = 3, 4


def _key(id_col: str, text_col: str) -> Column:
    own = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.substring(F.md5(own), 1, DIGITS * LEVELS)


def targets(sizes: DataFrame) -> DataFrame:
    """Per source (columns source, source_size): idx, target, whole (copies of every document) and rest (words still to take)."""
    # one row per source from here on, so one window partition is small
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("idx") % len(WEIGHTS) + 1)
    own = sizes.withColumn("idx", F.row_number().over(by_code) - 1).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    # sources are capped in the order of cap / weight; the level is what the others get per weight
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    so_far = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(so_far), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0))
    )
    own = own.withColumn("level", level).withColumn("place", F.row_number().over(by_cap))
    # the first source whose cap reaches the level of what the sources before it left
    final = F.min_by("level", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("place"))).over(everything)
    own = own.withColumn("final", final)
    own = own.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.coalesce("final", F.lit(0.0)) * F.col("weight"))))
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")).cast("int"))
    return own.withColumn("whole", whole).select("source", "idx", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: the last hash prefix of the order (``prefix``), its rows (``n``) and how many of them are taken (``cut``).

    ``rows``: source, size, key.
    """
    sources = sources.select("source", "idx", "rest")
    rows = rows.join(sources, F.col("s").eqNullSafe(F.col("source")), "inner").select("idx", "rest", "size", "key") if "s" in rows.columns else rows
    bounds = sources.select("idx", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for level in range(LEVELS):
        part = F.substring("key", level * DIGITS + 1, DIGITS)
        inside = rows.join(bounds, "idx").where(F.substring("key", 1, level * DIGITS) == F.col("prefix")) if level else rows.join(bounds, "idx")
        histogram = inside.groupBy("idx", "rest", "prefix", "base", part.alias("part")).agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        running = Window.partitionBy("idx").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        ends = histogram.withColumn("end", F.col("base") + F.sum("w").over(running))
        # the first bucket that reaches over the budget holds the end; without one, all documents are taken
        bounds = ends.where("end > rest").groupBy("idx").agg(F.min(F.struct("part", "prefix", "end", "w", "n", "rest")).alias("b"))
        bounds = settle(bounds.select("idx", F.concat("b.prefix", "b.part").alias("prefix"), (F.col("b.end") - F.col("b.w")).alias("base"), F.col("b.w").alias("w"), F.col("b.n").alias("n"), F.col("b.rest").alias("budget")), "mix-bounds")
        if level + 1 < LEVELS:
            bounds = bounds.drop("w", "n", "budget")
    cut = F.floor(F.col("n") * (F.col("budget") - F.col("base")) / F.col("w") + 0.5)
    return bounds.select("idx", "prefix", "n", cut.alias("cut"))


def _numbered(inside: DataFrame) -> DataFrame:
    """Boundary rows with ``_mix_more``: whether the row is among the first ``_mix_cut`` of its source's."""
    rows = settle(inside.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-boundary").withColumn("_mix_task", F.shiftright("_mix_row", 33))
    # a row a source and task
    counts = rows.groupBy("_mix_idx", "_mix_task").agg(F.count("*").alias("_mix_rows"))
    so_far = Window.partitionBy("_mix_idx").orderBy("_mix_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_mix_before", F.coalesce(F.sum("_mix_rows").over(so_far), F.lit(0))).drop("_mix_rows")
    place = F.row_number().over(Window.partitionBy("_mix_idx", "_mix_task").orderBy("_mix_row"))
    placed = rows.withColumn("_mix_place", place).join(before, ["_mix_idx", "_mix_task"])
    return placed.withColumn("_mix_more", F.col("_mix_before") + F.col("_mix_place") <= F.col("_mix_cut"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out: str = "mix") -> DataFrame:
    """``docs`` with a struct column ``out``: size, source_size, target, copies (0 to 3)."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = settle(docs.select(F.col(source_col).alias("s"), size.alias("size"), _key(id_col, text_col).alias("key")), "mix-rows")
    sources = settle(targets(rows.groupBy(F.col("s").alias("source")).agg(F.sum("size").alias("source_size"))), "mix-sources")
    ends = thresholds(rows, sources)
    # a row per source: the files' size tells the planner whether to broadcast it
    plan = settle(sources.join(ends, "idx", "left"), "mix-plan").select(*[F.col(c).alias(f"_mix_{c}") for c in ("idx", "source", "source_size", "target", "whole", "prefix", "n", "cut")])
    key = F.col("_mix_key")
    boundary = F.coalesce((key == F.col("_mix_prefix")) & (F.col("_mix_n") > 1), F.lit(False))
    more = F.col("_mix_prefix").isNull() | (key < F.col("_mix_prefix")) | ((key == F.col("_mix_prefix")) & (F.col("_mix_cut") > 0))
    copies = F.col("_mix_whole") + F.when(F.col("_mix_more") & (F.col("_mix_whole") < MOST), 1).otherwise(0)
    keyed = docs.withColumns({"_mix_size": size, "_mix_key": _key(id_col, text_col)})
    joined = keyed.join(plan, F.col(source_col).eqNullSafe(F.col("_mix_source")))
    chosen = joined.withColumn("_mix_more", more)
    # only where a boundary bucket holds several rows are those rows numbered
    if plan.where("_mix_n > 1").limit(1).count():
        chosen = chosen.where(~boundary).unionByName(_numbered(joined.where(boundary)).select(*chosen.columns))
    mixed = F.struct(F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), copies.cast("int").alias("copies"))
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], mixed.alias(out))


def take(docs: DataFrame, **columns: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    mixed = mix(docs, out="_mix", **columns).where("_mix.copies > 0")
    return mixed.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix.copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


QUERIES = {"op8_mix_sources": op8_mix_sources}

SQL = {
    "op8_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS idx
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][idx % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER o, 0))
          / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level,
         row_number() OVER (ORDER BY cap / weight, idx) AS place
  FROM w WINDOW o AS (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, place) AS final FROM l WHERE cap >= level * weight),
t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0
         ELSE least(CAST(cap AS DOUBLE), coalesce(final, 0.0) * weight) END AS target FROM l, f),
r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
g AS (
  SELECT d.source, k, CAST(sum(size) AS BIGINT) AS gw, count(*) AS n FROM d GROUP BY d.source, k),
c AS (
  SELECT g.source, g.k, g.gw, g.n, r.target - r.whole * r.source_size AS rest,
         sum(g.gw) OVER (PARTITION BY g.source ORDER BY g.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
x AS (
  SELECT source, k, CASE WHEN e <= rest THEN n WHEN e - gw <= rest THEN floor(n * (rest - (e - gw)) / gw + 0.5) ELSE 0 END AS cut FROM c)
SELECT d.doc_id, d.size, r.source_size, r.target,
       d.size * (r.whole + CASE WHEN row_number() OVER (PARTITION BY d.source, d.k) <= x.cut AND r.whole < 3 THEN 1 ELSE 0 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.k = x.k
"""
}
