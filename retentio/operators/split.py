"""Reproducible stratified split, folds and sampling (M1-M3).

The reference splits by random row position, which cannot be reproduced
from a key. Here the order inside each class is ``md5('<seed>:' || key)``,
so a customer's split never depends on partitioning or on re-runs.

``method="exact"`` gives exact per-class sizes, like a stratified split:
per class with ``n`` rows, ``ceil(n/5)`` test rows, ``ceil((n - test)/4)``
validation rows (20% of the total), the rest train; training rows get
``fold = position % 5``. Positions come from the distributed rank plan
(``plans.ordered``), never from a window over a two-valued class column.

``method="hash"`` maps the hash to [0, 1) and uses thresholds 0.2 / 0.4:
no shuffle at all, sizes exact only in expectation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.plans.broadcast import broadcast_bounded
from retentio.plans.ordered import default_buckets, hash_bucket, ordinal_rank


def key_hash(key: str, seed: int = K.SEED) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def unit_hash(key: str, seed: int = K.SEED) -> F.Column:
    """The first 52 bits of the md5 hash as a double in [0, 1)."""
    return F.conv(F.substring(key_hash(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def assign_split(
    df: DataFrame,
    key: str = "customer_id",
    label: str = "Churn",
    seed: int = K.SEED,
    method: str = "exact",
) -> DataFrame:
    """Add ``split`` (train / val / test) and ``fold`` (0-4 for train rows)."""
    if method == "hash":
        u = unit_hash(key, seed)
        fold_u = unit_hash(key, seed + 1)
        split = F.when(u < K.TEST_FRACTION, "test").when(u < K.TEST_FRACTION + K.VAL_FRACTION, "val").otherwise("train")
        return df.withColumn("split", split).withColumn(
            "fold", F.when(F.col("split") == "train", F.floor(fold_u * K.N_FOLDS).cast("int"))
        )
    if method != "exact":
        raise ValueError("method must be 'exact' or 'hash'")

    # The rows travel through the rank plan whole: two range-partitioned
    # shuffles and no join back on the key afterwards.
    keyed = df.withColumn("_h", key_hash(key, seed))
    bucket = hash_bucket("_h", default_buckets(df))
    ranked = ordinal_rank(keyed, ["_h", key], strata=[label], name="_r", bucket=bucket)
    # class sizes: one row per label value
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    test_n = F.floor((F.col("_n") + 4) / 5)
    sized = sizes.select(F.col(label).alias("_class"), test_n.alias("_t"), F.floor((F.col("_n") - test_n + 3) / 4).alias("_v"))
    r, t, v = F.col("_r"), F.col("_t"), F.col("_v")
    # a null class is a class: no row is lost
    return ranked.join(broadcast_bounded(sized, 10_000), F.col(label).eqNullSafe(F.col("_class"))).select(
        *df.columns,
        F.when(r < t, F.lit("test")).when(r < t + v, F.lit("val")).otherwise(F.lit("train")).alias("split"),
        F.when(r >= t + v, ((r - t - v) % K.N_FOLDS).cast("int")).alias("fold"),
    )


def sample_rows(df: DataFrame, n: int, key: str = "customer_id", seed: int = K.SEED) -> DataFrame:
    """``n`` rows without replacement, reproducible from the key (M2).

    A top-n by hash: each task keeps its n smallest, then one merge of
    ``n x tasks`` rows; the limit is the feature.
    """
    return df.orderBy(key_hash(key, seed), F.col(key)).limit(n)
