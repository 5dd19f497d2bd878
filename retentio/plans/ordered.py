"""Running totals in a global order without pulling rows into one task.

A window with ``orderBy`` but no ``partitionBy`` (or partitioned by a
two-valued class column) runs in a single task. The plan used here instead:

1. Every row gets a *bucket*: a monotone, deterministic function of the
   first order column (bucket(a) <= bucket(b) whenever a < b). For a hash
   key the bucket is a prefix of the hash; for a numeric key it is a binary
   search over B-1 bounds taken once from ``percentile_approx`` (an array of
   numbers, fixed as one literal, so every re-evaluation of the plan,
   including after a lost executor, puts a row in the same bucket). Each step
   of the search is a column of its own, so the generated code stays small at
   any number of bounds. A null is in the first bucket.
2. A window partitioned by (strata, bucket) gives running sums inside each
   bucket: one shuffle, B buckets per stratum spread over the tasks.
3. Bucket totals per stratum form a table of at most B x strata rows. Their
   running offsets are computed on that small table and joined back
   null-safely, broadcast only if a count shows that it is small.

Callers collapse duplicate keys first (``groupBy(value)`` with partial
aggregation) so a hot value is one row and cannot overload a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.plans.broadcast import broadcast_bounded

_B = "_rt_bucket"
_W = "_rt_w"
_LOCAL = "_rt_local"
_OFF = "_rt_off"
#: Rows of the offsets up to which they are broadcast.
BROADCAST_ROWS = 100_000


def default_buckets(df: DataFrame) -> int:
    """Buckets: four per shuffle partition, 8 at least."""
    return max(8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _search(col: Column, bounds: list[float], lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2
    return F.when(col < F.lit(bounds[mid - 1]), _search(col, bounds, lo, mid - 1)).otherwise(
        _search(col, bounds, mid, hi)
    )


def numeric_bucket(df: DataFrame, column: str, buckets: int | None = None, accuracy: int = 10_000) -> Column:
    """Bucket expression for a numeric column from approximate quantiles.

    Runs one aggregate job and brings back at most ``buckets - 1`` numbers.
    Returns a nested ``CASE`` (binary search, depth log2(buckets)): for few
    buckets; ``with_numeric_bucket`` serves any number.
    """
    bounds = bucket_bounds(df, column, buckets, accuracy)
    if not bounds:
        return F.lit(0)
    return _search(F.col(column).cast("double"), bounds, 0, len(bounds))


def bucket_bounds(df: DataFrame, column: str, buckets: int | None = None, accuracy: int = 10_000) -> list[float]:
    """Distinct approximate quantiles that cut ``column`` into ``buckets``."""
    b = buckets or default_buckets(df)
    probs = [i / b for i in range(1, b)]
    row = df.agg(F.percentile_approx(F.col(column).cast("double"), probs, max(accuracy, 10 * b)).alias("b")).first()
    return sorted({float(x) for x in (row["b"] or []) if x is not None})


def with_numeric_bucket(df: DataFrame, column: str, out: str, buckets: int | None = None) -> DataFrame:
    """``df`` with the bucket of ``column`` as ``out``: the number of bounds that are not above it."""
    bounds = bucket_bounds(df, column, buckets)
    if not bounds:
        return df.withColumn(out, F.lit(0))
    table, x, at = F.lit(bounds), F.col(column).cast("double"), F.lit(0)
    staged, names = df, []
    for bit in reversed(range(len(bounds).bit_length())):
        # a column per step: the next one reads it twice without repeating it
        inside = F.get(table, at + F.lit((1 << bit) - 1)) <= x
        names.append(f"{out}_{bit}")
        staged = staged.withColumn(names[-1], at + F.when(inside, F.lit(1 << bit)).otherwise(0))
        at = F.col(names[-1])
    return staged.withColumn(out, at).drop(*names)


def hash_bucket(hex_hash: Column | str, buckets: int) -> Column:
    """Bucket of a lowercase hex hash: its first 8 digits scaled to ``buckets``; 0 for a null."""
    h = F.col(hex_hash) if isinstance(hex_hash, str) else hex_hash
    prefix = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    return F.coalesce(F.floor(prefix * F.lit(buckets) / F.lit(1 << 32)).cast("int"), F.lit(0))


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    weights: dict[str, Column | str] | None = None,
    strata: Sequence[str] = (),
    bucket: Column | None = None,
    inclusive: bool = True,
    row_number: str | None = None,
) -> DataFrame:
    """Add running sums of ``weights`` in ascending ``order`` within ``strata``.

    ``weights`` maps output column -> weight expression; each output is the
    sum of that weight over the rows of the stratum that come before the row
    (and the row itself when ``inclusive``). ``row_number`` adds a 0-based
    position. ``bucket`` must be monotone in ``order[0]``; by default it is
    derived from ``order[0]`` with ``with_numeric_bucket``. The order must be
    unique within a stratum for positions to be defined; null is a stratum.
    """
    weights = dict(weights or {})
    if row_number:
        weights[row_number] = F.lit(1).cast("long")
    if not weights:
        raise ValueError("running_totals needs at least one weight or row_number")
    names = list(weights)
    tmp = {name: f"{_W}{i}" for i, name in enumerate(names)}

    staged = with_numeric_bucket(df, order[0], _B) if bucket is None else df.withColumn(_B, bucket)
    for name, expr in weights.items():
        staged = staged.withColumn(tmp[name], F.col(expr) if isinstance(expr, str) else expr)

    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local_w = Window.partitionBy(*strata, _B).orderBy(*order).rowsBetween(*frame)
    local = staged.select(
        "*", *[F.coalesce(F.sum(tmp[nm]).over(local_w), F.lit(0)).alias(f"{_LOCAL}{tmp[nm]}") for nm in names]
    )

    totals = staged.groupBy(*strata, _B).agg(*[F.sum(tmp[nm]).alias(tmp[nm]) for nm in names])
    before = Window.partitionBy(*strata).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*strata, _B]
    offsets = totals.select(
        *[F.col(k).alias(f"{_OFF}_{k}") for k in keys],
        *[F.coalesce(F.sum(tmp[nm]).over(before), F.lit(0)).alias(f"{_OFF}{tmp[nm]}") for nm in names],
    )
    # without strata there is a row per bucket; else the rows are counted
    small = broadcast_bounded(offsets, BROADCAST_ROWS) if strata else F.broadcast(offsets)
    same = [F.col(k).eqNullSafe(F.col(f"{_OFF}_{k}")) for k in keys]
    out = local.join(small, reduce(lambda a, b: a & b, same))
    for name in names:
        out = out.withColumn(name, F.col(f"{_OFF}{tmp[name]}") + F.col(f"{_LOCAL}{tmp[name]}"))
    drop = [_B, *tmp.values(), *[f"{_LOCAL}{t}" for t in tmp.values()], *[f"{_OFF}{t}" for t in tmp.values()], *[f"{_OFF}_{k}" for k in keys]]
    return out.drop(*drop)


def ordinal_rank(
    df: DataFrame,
    order: Sequence[str],
    strata: Sequence[str] = (),
    name: str = "rank",
    bucket: Column | None = None,
) -> DataFrame:
    """0-based position of each row in ``order`` within ``strata``."""
    return running_totals(df, order, strata=strata, bucket=bucket, inclusive=False, row_number=name)
