"""The prepared subscriber table and fitted models, built once per input.

Preparation has two data-dependent constants (fiber cut, CLV quartile
edges) and a stratified split; every report, metric and model reads its
output. ``Workspace`` builds each stage once and writes it as parquet
(the prepared table partitioned by ``split``) under the session's shared
checkpoint folder (``spark.checkpoint.dir``). Later plans start at those
files: lineage is cut (a lost executor re-reads files instead of
re-aggregating ``orders``) and ``where split = ...`` prunes folders.

Stages and models are kept in the store of the checkpoint folder
(``plans.store``) under a hash of the input files (path, size, modification
time), the settings and the code: one process builds each, every other session
that sees the folder reads it, and changed inputs give another key.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from retentio.operators import prepare as P
from retentio.operators import quality as Q
from retentio.operators.split import assign_split
from retentio.plans.lineage import path_exists, remove_scratch
from retentio.plans.store import Store, artifact_key
from retentio.schema import RAW_COLUMNS
from retentio.sources.subscribers import load_subscribers

# Registered model queries run the published searches in full. The tests set
# "quick" (one point per model): they check plans and invariants, not quality.
GRID = "reference"
# Final fits that are submitted at once.
PARALLEL_FITS = 3

# Folder of a stage's observations; readers of the table skip names with an underscore.
OBSERVED = "_observed"

_LOCK = threading.RLock()
_ARTIFACTS: dict[tuple, dict[str, str]] = {}


def _signature(spark: SparkSession, sf_dir: str) -> tuple:
    """(path, bytes, modification time) of every input file, through Hadoop's FileSystem.

    An input that cannot be listed is an error: a key without its files would match other states.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in ("customer", "orders"):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            st = files.next()
            out.append((name, str(st.getPath().toString()), int(st.getLen()), int(st.getModificationTime())))
    return tuple(sorted(out))


def _artifact_key(spark: SparkSession, sf_dir: str, exact: bool) -> tuple:
    return (sf_dir.rstrip("/"), _signature(spark, sf_dir), exact)


class Workspace:
    """``fit_on="all"`` fits the fiber cut and CLV quartile edges on every row,
    as the reference does; ``fit_on="train"`` fits them on the training split
    only (no test rows leak into the constants). The split depends only on the
    key and the label, so it can be assigned before the constants are fitted.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, exact: bool = True, fit_on: str = "all"):
        if fit_on not in ("all", "train"):
            raise ValueError("fit_on must be 'all' or 'train'")
        self.spark = spark
        self.sf_dir = sf_dir
        self.exact = exact
        self.fit_on = fit_on
        self._key = _artifact_key(spark, sf_dir, exact) + (fit_on,)
        self._paths = _ARTIFACTS.setdefault(self._key, {})
        self._store = Store(spark)
        self._frames: dict[str, DataFrame] = {}
        self._objects: dict[str, object] = {}

    def _artifact(self, name: str, build, mark: str) -> str:
        """The folder of an artifact of this workspace, built if no session has built it."""
        path = self._paths.get(name)
        if path is None or not path_exists(self.spark, f"{path}/{mark}"):
            path = self._paths[name] = self._store.get(artifact_key(name, *self._key), build)
        return path

    def _stage(self, name: str, build, partition_by: list[str] | None = None) -> DataFrame:
        """A written table. ``build`` may return (rows, observation): its metrics are kept beside the table."""
        def write(path: str) -> None:
            rows = build()
            rows, seen = rows if isinstance(rows, tuple) else (rows, None)
            writer = rows.write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            if seen is not None:
                one = self.spark.createDataFrame([Row(**seen.get)])  # one row, taken while writing
                one.coalesce(1).write.parquet(f"{path}/{OBSERVED}")

        with _LOCK:
            if name not in self._frames:
                self._frames[name] = self.spark.read.parquet(self._artifact(name, write, "_SUCCESS"))
            return self._frames[name]

    def observed(self, name: str) -> DataFrame:
        """One row: what was observed while the stage (``cleaned`` or ``prepared``) was written."""
        with _LOCK:
            getattr(self, name)
            return self.spark.read.parquet(f"{self._paths[name]}/{OBSERVED}")

    def close(self) -> list[str]:
        """Remove this session's scratch folders and what dead owners left in the store; published tables stay.

        Returns what was removed. Frames made by queries before are not readable after.
        """
        self._frames.clear()
        self._objects.clear()
        return remove_scratch(self.spark) + self._store.sweep()

    @property
    def raw(self) -> DataFrame:
        return load_subscribers(self.spark, self.sf_dir)

    @property
    def cleaned(self) -> DataFrame:
        """Typed subscriber rows, written once: ``orders`` is aggregated a single
        time however many plans (cuts, features, split ranks) read them."""
        def build():
            seen = Observation("raw")
            return P.clean(self.raw.observe(seen, *Q.missing_sums(RAW_COLUMNS), *Q.conversion_sums())), seen
        return self._stage("cleaned", build)

    @property
    def cuts(self) -> DataFrame:
        """One row: fiber_cut, clv_min, q1, q2, q3, clv_max."""
        def build():
            rows = self.cleaned
            if self.fit_on == "train":
                rows = assign_split(rows).where(F.col("split") == "train")
            return P.fit_cuts(rows, exact=self.exact)
        return self._stage("cuts", build)

    @property
    def prepared(self) -> DataFrame:
        """Cleaned, engineered, CLV quartile, split and fold; read from files."""
        def build():
            seen = Observation("prepared")
            sums = [*Q.class_sums(), *Q.anomaly_sums(), *Q.flag_sums(), *Q.balance_sums()]
            return assign_split(P.prepare_cleaned(self.cleaned, cuts=self.cuts)).observe(seen, *sums), seen
        return self._stage("prepared", build, partition_by=["split"])

    @property
    def codes(self):
        """Alphabetical codes of the string features, fitted on all prepared rows."""
        with _LOCK:
            if "codes" not in self._objects:
                from retentio.operators.encode import fit_codes
                self._objects["codes"] = fit_codes(self.prepared)
            return self._objects["codes"]

    @property
    def encoded(self) -> DataFrame:
        """Prepared rows with every string feature replaced by its code."""
        from retentio.operators.encode import encode
        return encode(self.prepared, self.codes)

    def model_path(self, grid: str | None = None) -> str:
        """Folder of the combined scoring pipeline, its constants and searches (IO6)."""
        from retentio.ml.models import save, train_models

        grid = grid or GRID

        def write(path: str) -> None:
            save(train_models(self.prepared, grid=grid, parallelism=PARALLEL_FITS), path, self.cuts)

        with _LOCK:
            self.prepared, self.cuts  # their own artifacts, built before the model's claim is taken
            return self._artifact(f"model:{grid}", write, "metadata")

    def model(self, grid: str | None = None):
        """The combined scoring pipeline, loaded from the store."""
        from retentio.ml.models import load

        key = f"model:{grid or GRID}"
        with _LOCK:
            if key not in self._objects:
                self._objects[key] = load(self.model_path(grid))
            return self._objects[key]

    def search(self, grid: str | None = None) -> DataFrame:
        """The searches of the model: a row for each model, point and fold."""
        return self.spark.read.parquet(f"{self.model_path(grid)}/search")

    def fitted_cut(self, grid: str | None = None) -> float:
        """The fiber cut saved beside the model: requests get the features it was trained on."""
        from retentio.ml.models import fitted_cut

        return fitted_cut(self.spark, self.model_path(grid))

    def trained(self, grid: str | None = None):
        """Fitted feature stages and models, taken from the saved pipeline."""
        from retentio.ml.models import TrainedModels

        key = f"trained:{grid or GRID}"
        with _LOCK:
            if key not in self._objects:
                self._objects[key] = TrainedModels.from_combined(self.model(grid), self.model_path(grid))
            return self._objects[key]

    def split(self, *names: str) -> DataFrame:
        return self.prepared.where(F.col("split").isin(list(names)))

    def report_rows(self, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
        """Rows the CLV reports use: train and test, validation left out."""
        if splits == ("all",):
            return self.prepared
        return self.split(*splits)


_SESSIONS: dict[tuple, Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str, exact: bool = True, fit_on: str = "all") -> Workspace:
    """The workspace of ``sf_dir`` bound to ``spark`` (artifacts shared)."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"), exact, fit_on)
    with _LOCK:
        ws = _SESSIONS.get(key)
        if ws is None or ws._paths is not _ARTIFACTS.get(_artifact_key(spark, sf_dir, exact) + (fit_on,)):
            ws = _SESSIONS[key] = Workspace(spark, sf_dir, exact, fit_on)
        return ws
