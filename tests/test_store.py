"""The store of written artifacts: one builder, waiting readers, dead owners, sweeping."""

import os
import threading
import time


import pytest

from retentio.plans.store import Store, artifact_key


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", lease_s=1.5)


def _writer(spark, value, built, wait=0.0):
    def build(path):
        built.append(value)
        time.sleep(wait)
        spark.range(value).write.parquet(path)
    return build


def test_one_builder_many_readers(spark, store):
    built, paths = [], []

    def ask(n):
        paths.append(store.get("k", _writer(spark, n, built, 1.0)))

    threads = [threading.Thread(target=ask, args=(n,)) for n in (3, 4, 5, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(built) == 1 and len(set(paths)) == 1
    assert spark.read.parquet(paths[0]).count() == built[0]
    assert store.published("k") == paths[0]


def test_failed_build_leaves_nothing_and_can_be_repeated(spark, store, tmp_path):
    def broken(path):
        spark.range(2).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.get("k", broken)
    assert store.published("k") is None
    assert not [f for f in os.listdir(f"{tmp_path}/store/k") if not f.startswith(".")]
    assert spark.read.parquet(store.get("k", _writer(spark, 7, []))).count() == 7


def test_dead_owner_is_replaced_and_its_folder_removed(spark, store, tmp_path):
    spark.range(1).write.parquet(f"file://{tmp_path}/store/k/data-dead")
    assert store._write(f"{store.root}/k/claim", "dead 0", overwrite=False)
    path = store.get("k", _writer(spark, 5, []))
    assert spark.read.parquet(path).count() == 5
    left = {f for f in os.listdir(f"{tmp_path}/store/k") if not f.startswith(".")}
    assert left == {"published", os.path.basename(path)}


def test_a_living_owner_keeps_its_claim(spark, tmp_path):
    store, built = Store(spark, f"file://{tmp_path}/store", lease_s=1.0), []
    first = threading.Thread(target=store.get, args=("k", _writer(spark, 2, built, 4.0)))
    first.start()
    time.sleep(0.5)
    store.get("k", _writer(spark, 3, built))
    first.join()
    assert built == [2]


def test_sweep_keeps_published_and_living(spark, store, tmp_path):
    kept = store.get("a", _writer(spark, 3, []))
    spark.range(1).write.parquet(f"file://{tmp_path}/store/a/data-old")
    spark.range(1).write.parquet(f"file://{tmp_path}/store/b/data-dead")
    store._write(f"{store.root}/b/claim", "dead 4", overwrite=False)
    gone = store.sweep()
    assert {os.path.basename(g) for g in gone} == {"data-old", "data-dead"}
    assert store.published("a") == kept and spark.read.parquet(kept).count() == 3
    assert store._read(f"{store.root}/b/claim") is None


def test_keys_follow_every_part():
    a = artifact_key("prepared", "/d", (("customer", "/d/c.parquet", 5, 9),), True, "all")
    assert a == artifact_key("prepared", "/d", (("customer", "/d/c.parquet", 5, 9),), True, "all")
    assert a != artifact_key("prepared", "/d", (("customer", "/d/c.parquet", 5, 10),), True, "all")
    assert a != artifact_key("cuts", "/d", (("customer", "/d/c.parquet", 5, 9),), True, "all")


def test_a_second_session_loads_the_model_without_a_fit(spark, monkeypatch):
    import retentio.ml.models as models
    import retentio.workspace as W

    data = "/root/testdata/sf0.001"
    first = W.workspace(spark, data)
    path = first.model_path()
    # as another process: nothing remembered, and no fit or preparation allowed
    monkeypatch.setattr(W, "_ARTIFACTS", {})
    monkeypatch.setattr(W, "_SESSIONS", {})

    def never(*_, **__):
        raise AssertionError("built again")

    monkeypatch.setattr(models, "train_models", never)
    monkeypatch.setattr(W.P, "clean", never)
    second = W.workspace(spark.newSession(), data)
    assert second.model_path() == path
    assert second.model().stages and second.search().count() > 0
    # changed settings are another artifact
    other = W.workspace(spark, data, fit_on="train")
    assert artifact_key("x", *other._key) != artifact_key("x", *second._key)


def test_changed_inputs_are_another_artifact(spark, tmp_path):
    import shutil

    from retentio.workspace import _artifact_key

    for name in ("customer", "orders"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", f"{tmp_path}/{name}.parquet")
    a = _artifact_key(spark, str(tmp_path), True)
    os.utime(f"{tmp_path}/orders.parquet", (1, 1))
    assert _artifact_key(spark, str(tmp_path), True) != a
