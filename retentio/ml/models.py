"""Model pipelines on ``pyspark.ml`` (L1-L9, L13, J3, L6, L7, IO5, IO6).

Stages:

* features: ``StringIndexer`` (alphabetical codes, unseen values fail) and
  ``VectorAssembler`` over the 27 model features in their fixed order;
* logistic: ``StandardScaler`` (mean and std fitted on train only) and
  ``LogisticRegression`` with balanced class weights;
* random forest: 100 trees, balanced class weights;
* boosted: ``GBTClassifier``, 100 rounds, positives weighted neg/pos.

Each model writes its own output columns (``prob_<model>`` ...), so one
``PipelineModel`` can hold the feature stages and all three models and
score a table (or a stream) in a single projection.

The grid searches run over the precomputed ``fold`` column (stratified,
reproducible) and compare mean exact AUC on the held-out folds. All logistic
fits go through one loop of Newton steps over all training rows (``ml.newton``);
the tree fits are tasks of one job on a bounded part of them (``ml.tree_search``).
The chosen points are then fitted by ``pyspark.ml`` on all training rows.

The sklearn penalty ``C`` on summed loss maps to MLlib's ``regParam`` on
mean loss as ``1 / (C * sum of weights)``; with balanced weights the sum of
weights is the number of training rows.
"""

from __future__ import annotations

import logging
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.ml import newton, tree_search
from retentio.ml.nodes import saved_nodes, write_nodes
from retentio.operators import metrics as M
from retentio.operators.encode import SUFFIX, label_indexer
from retentio.operators.quality import class_weights
from retentio.operators.split import unit_hash

log = logging.getLogger(__name__)

LABEL = "Churn"
FEATURES = "features"
TREES = {"random_forest": "forest", "boosted": "boosted"}
W_BALANCED = "w_balanced"
W_BOOST = "w_boost"
# Training rows of one task; a larger table has as many more partitions.
TRAIN_ROWS_PER_PARTITION = 50_000


def assembled_inputs() -> list[str]:
    return [f"{c}{SUFFIX}" if c in K.STRING_FEATURES else c for c in K.FEATURE_COLUMNS]


def feature_stages() -> Pipeline:
    return Pipeline(stages=[
        label_indexer(K.STRING_FEATURES),
        VectorAssembler(inputCols=assembled_inputs(), outputCol=FEATURES, handleInvalid="error"),
    ])


def cols(model: str) -> dict[str, str]:
    return {"raw": f"raw_{model}", "prob": f"prob_{model}", "pred": f"pred_{model}"}


def logistic_estimator() -> Pipeline:
    c = cols("logistic")
    scaler = StandardScaler(inputCol=FEATURES, outputCol="scaled_logistic", withMean=True, withStd=True)
    lr = LogisticRegression(
        featuresCol="scaled_logistic", labelCol=LABEL, weightCol=W_BALANCED, standardization=False,
        elasticNetParam=0.0, maxIter=K.LOGISTIC_MAX_ITER, rawPredictionCol=c["raw"],
        probabilityCol=c["prob"], predictionCol=c["pred"],
    )
    return Pipeline(stages=[scaler, lr])


def forest_estimator() -> RandomForestClassifier:
    c = cols("random_forest")
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=W_BALANCED, numTrees=K.FOREST_TREES, seed=K.SEED,
        rawPredictionCol=c["raw"], probabilityCol=c["prob"], predictionCol=c["pred"],
    )


def boosted_estimator() -> GBTClassifier:
    c = cols("boosted")
    gbt = GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=W_BOOST, maxIter=K.BOOST_ROUNDS, seed=K.SEED,
        predictionCol=c["pred"],
    )
    return gbt.setRawPredictionCol(c["raw"]).setProbabilityCol(c["prob"])


def grid_points(name: str, grid: str = "reference") -> list[dict]:
    """The points of a model's published grid, or one of them ("quick")."""
    full = grid == "reference"
    if name == "logistic":
        return [{"c": c} for c in (K.LOGISTIC_C_GRID if full else (1.0,))]
    if name == "random_forest":
        depths = [d if d is not None else K.FOREST_UNLIMITED_DEPTH for d in K.FOREST_DEPTH_GRID] if full else [10]
        return [{"depth": d, "min_leaf": n} for d in depths for n in (K.FOREST_LEAF_GRID if full else (2,))]
    return [{"depth": d, "rate": r} for d in (K.BOOST_DEPTH_GRID if full else (3,)) for r in (K.BOOST_RATE_GRID if full else (0.1,))]


def point_name(point: dict) -> str:
    return ", ".join(f"{k}={v}" for k, v in point.items())


def with_weights(train: DataFrame) -> DataFrame:
    """Attach balanced and boosting weights (J3): a two-row class table, broadcast."""
    w = class_weights(train, LABEL).select(
        LABEL, F.col("balanced_weight").alias(W_BALANCED), F.col("boost_weight").alias(W_BOOST)
    )
    return train.join(F.broadcast(w), LABEL)


@dataclass
class TrainedModels:
    features: PipelineModel
    models: dict[str, object]
    cv_auc: dict[str, float] = field(default_factory=dict)
    params: dict[str, dict] = field(default_factory=dict)
    search: list[dict] = field(default_factory=list)
    nodes: dict[str, str] = field(default_factory=dict)  # written node relations of the tree models

    @classmethod
    def from_combined(cls, model: PipelineModel, path: str | None = None) -> "TrainedModels":
        """Split a saved combined pipeline back into feature stages and models; ``path`` is where it was saved."""
        from pyspark.ml.classification import (
            GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel,
        )
        from pyspark.ml.feature import StandardScalerModel, StringIndexerModel

        feats, linear, models = [], [], {}
        for st in model.stages:
            if isinstance(st, (StringIndexerModel, VectorAssembler)):
                feats.append(st)
            elif isinstance(st, (StandardScalerModel, LogisticRegressionModel)):
                linear.append(st)
            elif isinstance(st, RandomForestClassificationModel):
                models["random_forest"] = st
            elif isinstance(st, GBTClassificationModel):
                models["boosted"] = st
        if linear:
            models["logistic"] = PipelineModel(stages=linear)
        nodes = {m: f"{path}/nodes/{m}" for m in TREES if path and m in models}
        return cls(features=PipelineModel(stages=feats), models=models, nodes=nodes)

    def combined(self) -> PipelineModel:
        """Feature stages followed by every model: scores all models in one pass."""
        stages = list(self.features.stages)
        for name in K.MODEL_NAMES:
            if name not in self.models:
                continue
            m = self.models[name]
            stages += list(m.stages) if isinstance(m, PipelineModel) else [m]
        return PipelineModel(stages=stages)


def _logistic_search(train: DataFrame, points: list[dict], n_train: float) -> list[dict]:
    """A row for each (point, fold): all fits in one loop, exact AUC of the folds left out."""
    sizes = {r.fold: (r.n, r.p) for r in train.groupBy("fold").agg(F.count("*").alias("n"), F.sum(LABEL).cast("long").alias("p")).collect()}
    pairs = [(point, fold) for point in points for fold in range(K.N_FOLDS)]
    problems = [newton.Problem(fold, 1.0 / (point["c"] * n_train)) for point, fold in pairs]
    fits = newton.fit_logistics(train, problems, FEATURES, LABEL, W_BALANCED)
    named = {f"{point['c']}/{fold}": (fold, fit) for (point, fold), fit in zip(pairs, fits, strict=True)}
    aucs = {r.model: r.auc_roc for r in M.auc(newton.held_out_scores(train, named, FEATURES, LABEL)).collect()}
    n, p = sum(v[0] for v in sizes.values()), sum(v[1] for v in sizes.values())
    out = []
    for point, fold in pairs:
        held_n, held_p = sizes.get(fold, (0, 0))
        out.append({"model": "logistic", "point": point, "fold": fold, "auc": aucs.get(f"{point['c']}/{fold}"),
                    "n_fit": n - held_n, "n_held": held_n, "fit_positives": p - held_p, "held_positives": held_p})
    return out


def _tree_search(spark: SparkSession, rows: tree_search.Rows, names: list[str], grid: str) -> list[dict]:
    """A row for each (model, point, fold) of the tree models: one job of independent tasks."""
    jobs = []
    for fold in range(K.N_FOLDS):
        if "random_forest" in names:
            points = grid_points("random_forest", grid)
            depths = tuple(sorted({p["depth"] for p in points}))
            jobs += [tree_search.Job("random_forest", fold, depths, n) for n in sorted({p["min_leaf"] for p in points})]
        if "boosted" in names:
            jobs += [tree_search.Job("boosted", fold, (p["depth"],), 1, p["rate"]) for p in grid_points("boosted", grid)]
    out = []
    for r in tree_search.search(spark, rows, jobs, K.FOREST_TREES, K.BOOST_ROUNDS, K.SEED):
        point = {"depth": r.depth, "min_leaf": r.min_leaf} if r.model == "random_forest" else {"depth": r.depth, "rate": r.rate}
        out.append({"point": point, **{k: r[k] for k in ("model", "fold", "auc", "n_fit", "n_held", "fit_positives", "held_positives")}})
    return out


def best_point(rows: list[dict], points: list[dict]) -> tuple[dict, float | None]:
    """The point of the highest mean AUC over the folds that have one; the first of equals."""
    means = []
    for point in points:
        aucs = [r["auc"] for r in sorted(rows, key=lambda r: r["fold"]) if r["point"] == point and r["auc"] is not None]
        means.append(math.fsum(aucs) / len(aucs) if aucs else None)
    best = max(range(len(points)), key=lambda i: (means[i] is not None, means[i] or 0.0, -i))
    return points[best], means[best]


def final_estimator(name: str, point: dict, n_train: float):
    """The estimator at a grid point, and its parameters by their names in ``pyspark.ml``."""
    if name == "logistic":
        est, params = logistic_estimator(), {"regParam": 1.0 / (point["c"] * n_train)}
        est.getStages()[1].setRegParam(params["regParam"])
    elif name == "random_forest":
        # a level of all trees in one job
        params = {"maxDepth": point["depth"], "minInstancesPerNode": point["min_leaf"]}
        est = forest_estimator().setMaxDepth(point["depth"]).setMinInstancesPerNode(point["min_leaf"]).setMaxMemoryInMB(1024)
    else:
        params = {"maxDepth": point["depth"], "stepSize": point["rate"]}
        est = boosted_estimator().setMaxDepth(point["depth"]).setStepSize(point["rate"])
    return est, params


def train_models(
    prepared: DataFrame,
    models: tuple[str, ...] = K.MODEL_NAMES,
    grid: str = "reference",
    parallelism: int = 4,
    search_rows: int = tree_search.SEARCH_ROWS,
) -> TrainedModels:
    """Fit the feature stages on all prepared rows and each model on train.

    ``prepared`` needs the ``split`` and ``fold`` columns. ``grid`` is
    "reference" (the full published grids) or "quick" (one point each).
    The tree searches fit on at most about ``search_rows`` training rows,
    taken by a hash of the customer; all else uses every training row.
    ``parallelism`` final fits are submitted at once.
    """
    from retentio.plans.lineage import write_stage

    spark = prepared.sparkSession
    features = feature_stages().fit(prepared)
    train = with_weights(prepared.where(F.col("split") == "train"))
    train = features.transform(train).select(FEATURES, LABEL, "fold", W_BALANCED, W_BOOST, unit_hash("customer_id").alias("_u"))
    # Read by every step of every fit: written once to the shared checkpoint
    # folder, then cached; a lost executor re-reads the files instead of
    # replaying the preparation.
    train = write_stage(train, "train_features")
    n_train = float(train.count())
    # Each round of each fit is a job: partitions follow the rows, so that a
    # small table does not pay for empty tasks hundreds of times.
    train = train.coalesce(max(1, math.ceil(n_train / TRAIN_ROWS_PER_PARTITION))).persist()
    out = TrainedModels(features=features, models={})
    trees = [m for m in models if m != "logistic"]
    try:
        found = []
        if trees:
            part = train if n_train <= search_rows else train.where(F.col("_u") < search_rows / n_train)
            flags = [c in K.STRING_FEATURES for c in K.FEATURE_COLUMNS]
            found += _tree_search(spark, tree_search.collect_rows(part, FEATURES, LABEL, W_BALANCED, W_BOOST, flags), trees, grid)
        if "logistic" in models:
            found += _logistic_search(train, grid_points("logistic", grid), n_train)
        estimators = {}
        for name in models:
            point, mean = best_point([r for r in found if r["model"] == name], grid_points(name, grid))
            estimators[name], out.params[name] = final_estimator(name, point, n_train)
            out.cv_auc[name] = mean
            out.search += [{**r, "chosen": r["point"] == point} for r in found if r["model"] == name]
            log.info("%s: best %s, cv auc %s", name, point, mean)
        # independent Spark jobs: submitted together they share the cluster
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(models)))) as pool:
            for name, fitted in zip(models, pool.map(lambda m: estimators[m].fit(train), models), strict=True):
                out.models[name] = fitted
    finally:
        train.unpersist()
    return out


SEARCH_SCHEMA = "model string, point string, fold int, auc double, n_fit long, n_held long, fit_positives long, held_positives long, chosen boolean"


def search_table(spark: SparkSession, models: TrainedModels) -> DataFrame:
    """The searches as rows: one for each model, point and fold."""
    rows = [(r["model"], point_name(r["point"]), r["fold"], r["auc"], r["n_fit"], r["n_held"], r["fit_positives"], r["held_positives"], r["chosen"]) for r in models.search]
    return spark.createDataFrame(rows, SEARCH_SCHEMA)


def probability(model: str) -> F.Column:
    """P(churn) from a model's probability vector."""
    return vector_to_array(F.col(cols(model)["prob"]))[1]


def save(models: TrainedModels, path: str, cuts: DataFrame | None = None) -> None:
    """Save the combined pipeline (IO5, IO6): feature order lives in the assembler.

    ``cuts`` (one row) are the constants the training features were made with. The
    searches, if any, and the node relations of the tree models are written beside them.
    """
    models.combined().write().overwrite().save(path)
    spark = SparkSession.active()
    for name, kind in TREES.items():
        if name in models.models:
            m = models.models[name]
            write_nodes(saved_nodes(spark, f"{path}/stages/*_{m.uid}/data", list(m.treeWeights), kind), f"{path}/nodes/{name}")
    if cuts is not None:
        cuts.write.mode("overwrite").parquet(f"{path}/constants")
    if models.search:
        search_table(spark, models).coalesce(1).write.mode("overwrite").parquet(f"{path}/search")


def fitted_cut(spark: SparkSession, path: str) -> float:
    """The fiber cut saved beside a model."""
    return float(spark.read.parquet(f"{path}/constants").first()["fiber_cut"])


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tree_importance(models: TrainedModels, name: str) -> list[tuple[str, float]]:
    """(feature, importance) from a tree model's ``featureImportances``."""
    m = models.models[name]
    imp = m.featureImportances.toArray()
    return [(f, float(v)) for f, v in zip(K.FEATURE_COLUMNS, imp)]


def linear_parameters(models: TrainedModels) -> list[tuple[str, float, float, float]]:
    """(feature, mean, std, coefficient) of the fitted scaler and logistic model."""
    scaler, lr = models.models["logistic"].stages
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    coef = lr.coefficients.toArray()
    return [(f, float(mean[i]), float(std[i]), float(coef[i])) for i, f in enumerate(K.FEATURE_COLUMNS)]
