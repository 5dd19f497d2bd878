"""Stratified split: exact sizes per class, reproducible, folds balanced."""

from pyspark.sql import functions as F

from retentio.operators.split import assign_split, sample_rows


def _rows(spark, n=3001):
    return spark.range(n).select(F.col("id").cast("string").alias("customer_id"),
                                 F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("Churn"))


def test_sizes_per_class(spark):
    out = assign_split(_rows(spark)).groupBy("Churn", "split").count().toPandas()
    for churn, g in out.groupby("Churn"):
        n = int(g["count"].sum())
        test = -(-n // 5)
        val = -(-(n - test) // 4)
        sizes = dict(zip(g["split"], g["count"]))
        assert sizes == {"test": test, "val": val, "train": n - test - val}


def test_reproducible_and_independent_of_partitioning(spark):
    a = assign_split(_rows(spark)).select("customer_id", "split", "fold")
    b = assign_split(_rows(spark).repartition(7)).select("customer_id", "split", "fold")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folds_balanced_within_class(spark):
    out = assign_split(_rows(spark)).where("split = 'train'").groupBy("Churn", "fold").count().toPandas()
    for _, g in out.groupby("Churn"):
        assert g["count"].max() - g["count"].min() <= 1
        assert sorted(g["fold"]) == [0, 1, 2, 3, 4]


def test_hash_method_is_close(spark):
    out = assign_split(_rows(spark, 20000), method="hash").groupBy("split").count().toPandas()
    frac = dict(zip(out["split"], out["count"] / 20000))
    assert abs(frac["test"] - 0.2) < 0.02 and abs(frac["val"] - 0.2) < 0.02


def test_sample_rows(spark):
    s = sample_rows(_rows(spark), 50)
    assert s.count() == 50 and s.select("customer_id").distinct().count() == 50


def test_constants_fitted_on_train_only(spark, sf_dir):
    import numpy as np
    from retentio.workspace import workspace
    ws = workspace(spark, sf_dir, fit_on="train")
    cut = ws.cuts.first().fiber_cut
    train = ws.prepared.where("split = 'train'").select("MonthlyCharges").toPandas()["MonthlyCharges"]
    assert cut == np.quantile(train.to_numpy(), 0.75)
    every = workspace(spark, sf_dir).cuts.first().fiber_cut
    assert ws.prepared.count() == workspace(spark, sf_dir).prepared.count()
    assert isinstance(every, float)
