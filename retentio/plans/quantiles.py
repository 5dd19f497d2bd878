"""Exact and approximate quantiles as distributed plans.

Exact form (linear interpolation between closest ranks, the definition used
by pandas ``quantile``/``qcut`` and by SQL ``percentile_cont``), by counting:

* a scan counts rows by power of two, with the least and largest value of each
  bin; that places every wanted rank of every stratum in one bin;
* a scan counts the rows of the wanted bins only, in ``BINS`` equal steps between
  their least and largest value, and so on while a bin holds more than
  ``FINAL`` rows of different values;
* a last scan counts the single values of the bins that are left.

A rank is then a value. Each scan is one aggregate with map-side partial sums whose
result is a few bins for each wanted rank; there is no sort of the rows, no window and no rank
table. Three scans are usual, and each further one divides the rows in question by up to ``BINS``. The bins of a rank
meet in its row, and rows are joined with the wanted bins by the power of two they lie in. The
approximate form is ``percentile_approx`` for when exactness is not needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.plans.broadcast import broadcast_bounded
from retentio.plans.lineage import checkpoint

BINS, FINAL = 4096, 4096
NAN_BIN, INF_BIN, SHIFT = 9000, 5000, 1100  # beyond all powers of two of doubles

_BIN = "struct<bin:double,n:bigint,mn:double,mx:double>"


def _power(v: F.Column) -> F.Column:
    """Number of the power of two of a double, in the order of the values: NaN last, as Spark sorts it."""
    size = (F.floor(F.log2(F.abs(v))) + SHIFT).cast("int")
    return (
        F.when(F.isnan(v), NAN_BIN).when(v == float("inf"), INF_BIN).when(v == float("-inf"), -INF_BIN)
        .when(v == 0, 0).when(v > 0, size).otherwise(-size)
    )


def _bins(counted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the array of their bins in order (at most ``BINS``, or the powers of two, or the single values)."""
    return counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n", "mn", "mx").cast(_BIN))).alias("bins"), F.sum("n").alias("total"))


def _locate(bins: F.Column, rank: F.Column) -> F.Column:
    """The bin that holds the 0-based ``rank``, with the rows below it: struct(below, n, mn, mx)."""
    state = "struct<below:bigint,n:bigint,mn:double,mx:double>"
    start = F.struct(F.lit(0), F.lit(None), F.lit(None), F.lit(None)).cast(state)

    def step(acc: F.Column, b: F.Column) -> F.Column:
        held = F.struct(acc["below"], b["n"], b["mn"], b["mx"]).cast(state)
        passed = F.struct(acc["below"] + b["n"], F.lit(None), F.lit(None), F.lit(None)).cast(state)
        return F.when(acc["n"].isNotNull(), acc).when(acc["below"] + b["n"] > rank, held).otherwise(passed)

    return F.aggregate(bins, start, step)


def quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    strata: Sequence[str] = (),
    exact: bool = True,
    accuracy: int = 100_000,
    strata_bound: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per stratum with a column per probability.

    ``names`` defaults to ``q0, q1, ...``. Nulls are ignored. Strata with no
    non-null value are absent from the result. ``strata_bound`` states a
    known bound on the number of strata (e.g. a fixed label domain); without
    it the wanted bins are counted before they are broadcast. ``weight`` names a count
    column when ``df`` is already collapsed to (value, count) rows. ``df`` is scanned
    about three times: give a written table, not a costly plan.
    """
    names = list(names or [f"q{i}" for i in range(len(probs))])
    if len(names) != len(probs):
        raise ValueError("one name per probability")
    strata = list(strata)
    if not exact:
        return (
            df.where(F.col(column).isNotNull())
            .groupBy(*strata)
            .agg(*[F.percentile_approx(column, float(p), accuracy).cast("double").alias(n) for p, n in zip(probs, names)])
        )

    own = [f"s{i}" for i in range(len(strata))]
    value = F.col(column).cast("double")
    rows = df.where(F.col(column).isNotNull()).select(
        *[F.col(s).alias(o) for s, o in zip(strata, own)], value.alias("v"), _power(value).alias("power"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"),
    )
    least = [F.sum("w").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")]
    first = _bins(rows.groupBy(*own, F.col("power").alias("bin")).agg(*least), own)

    # each probability wants the two ranks around its place
    place = F.col("p") * (F.col("total") - 1).cast("double")
    wanted = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    ranks = first.select(*own, "bins", "total", F.explode(wanted).alias("q")).select(*own, "bins", "total", "q.qi", "q.p").select(
        *own, "bins", "qi", (place - F.floor(place)).alias("frac"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("rank")))).alias("r"))
    keys = [*own, "qi", "side", "frac", "rank"]
    found = ranks.select(*own, "qi", "r.side", "frac", F.col("r.rank").cast("long").alias("rank"), "bins").select(*keys, _locate(F.col("bins"), F.col("rank")).alias("b")).select(*keys, "b.*")

    def kept(bins: DataFrame) -> DataFrame:
        """Cut the lineage: a rank and its bin, a row for each."""
        packed = bins.select(*own, F.struct("qi", "side", "frac", "rank").alias("wanted"), F.struct("below", "n", "mn", "mx", "power").alias("bin"))
        return checkpoint(packed).select(*own, "wanted.*", "bin.*")

    found = kept(found.withColumn("power", _power(F.col("mn"))))

    def refine(open_: DataFrame, step: F.Column) -> DataFrame:
        """The bins of the wanted ranks, cut by ``step`` (a column over v and the bin's mn and mx)."""
        side = open_.select(*[F.col(o).alias(f"b{o}") for o in own], F.col("power").alias("b_power"), "qi", "side", "frac", "rank", "below", F.col("mn").alias("b_mn"), F.col("mx").alias("b_mx"))
        if strata_bound is not None or not strata:
            side = F.broadcast(side)  # strata x probabilities x 2
        else:
            side = broadcast_bounded(side, max_rows=100_000)
        same = (F.col("power") == F.col("b_power")) & F.col("v").between(F.col("b_mn"), F.col("b_mx"))
        for o in own:
            same = F.col(o).eqNullSafe(F.col(f"b{o}")) & same
        met = rows.join(side, same)
        counted = met.groupBy(*keys, "below", step.cast("double").alias("bin")).agg(*least)
        each = _bins(counted, [*keys, "below"])
        cut = each.select(*keys, F.col("below").alias("before"), _locate(F.col("bins"), F.col("rank") - F.col("below")).alias("b"))
        return cut.select(*keys, (F.col("before") + F.col("b.below")).alias("below"), "b.n", "b.mn", "b.mx").withColumn("power", _power(F.col("mn")))

    several = F.col("mn") < F.col("mx")
    many = several & (F.col("n") > FINAL)
    share = (F.col("v") - F.col("b_mn")) / (F.col("b_mx") - F.col("b_mn"))
    while not found.where(many).isEmpty():
        found = kept(found.where(~many).unionByName(refine(found.where(many), F.least(F.floor(share * BINS), F.lit(BINS - 1)))))
    if not found.where(several).isEmpty():
        found = found.where(~several).unionByName(refine(found.where(several), F.col("v")))

    per_q = found.groupBy(*own, "qi").agg(
        F.max(F.when(F.col("side") == 0, F.col("mn"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("mn"))).alias("hi"), F.first("frac").alias("frac")
    )
    between = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")
    between = F.when(F.col("frac") == 0, F.col("lo")).otherwise(between)
    return per_q.groupBy(*[F.col(o).alias(s) for s, o in zip(strata, own)]).agg(
        *[F.max(F.when(F.col("qi") == i, between)).alias(n) for i, n in enumerate(names)]
    )
