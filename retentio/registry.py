"""Named queries: ``(spark, sf_dir) -> DataFrame``, one per operator group.

Each reads the driver's tables in ``sf_dir`` (through the subscriber source
and the session's prepared table) and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio import constants as K
from retentio.operators import attribution as A
from retentio.operators import encode as E
from retentio.operators import metrics as M
from retentio.operators import prepare as P
from retentio.operators import quality as Q
from retentio.operators import reports as R
from retentio.operators.split import sample_rows
from retentio.plans.lineage import scratch_path
from retentio.schema import RAW_COLUMNS
from retentio.workspace import workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _ws(spark, sf):
    return workspace(spark, sf)


# --- sources, cleaning, features, split -------------------------------------

@query("subscribers_raw")
def q_raw(spark, sf):
    return _ws(spark, sf).raw


@query("clean_subscribers")
def q_clean(spark, sf):
    return _ws(spark, sf).cleaned


@query("subscriber_features")
def q_features(spark, sf):
    return _ws(spark, sf).prepared.drop("split", "fold")


@query("serving_features")
def q_serving(spark, sf):
    raw = _ws(spark, sf).raw
    from retentio.functions.columns import to_number
    requests = raw.select(
        F.col("customerID").alias("customer_id"),
        *[c for c in raw.columns if c not in ("customerID", "TotalCharges", "Churn")],
        to_number("TotalCharges").alias("TotalCharges"),
    )
    return P.serving_features(requests)


@query("subscribers_csv")
def q_csv(spark, sf):
    """IO1: the raw table written as CSV and read back under the fixed schema."""
    from retentio.sources.files import read_raw_csv, write_raw_csv
    path = scratch_path(spark, "raw-csv")
    write_raw_csv(_ws(spark, sf).raw, path)
    return P.clean(read_raw_csv(spark, path))


@query("rejected_rows")
def q_rejected(spark, sf):
    """IO1, P3, J2: a CSV with bad lines and values, made of the raw table, read with its bad rows set aside.

    Every 50th customer pays by an unknown method, every 70th has no contract, every 90th a
    tenure that is no number, every 110th a negative charge.
    """
    from retentio.sources import quarantine as N
    from retentio.sources.files import write_raw_csv
    ws = _ws(spark, sf)
    k = F.col("customerID").cast("long")
    spoilt = ws.raw.withColumns({
        "PaymentMethod": F.when(k % 50 == 3, "Cheque").otherwise(F.col("PaymentMethod")),
        "Contract": F.when(k % 70 != 5, F.col("Contract")),
        "tenure": F.when(k % 90 == 7, "x").otherwise(F.col("tenure").cast("string")),
        "MonthlyCharges": F.when(k % 110 == 9, -F.col("MonthlyCharges")).otherwise(F.col("MonthlyCharges")),
    })
    path = scratch_path(spark, "spoilt-csv")
    write_raw_csv(spoilt, path)
    good, lines = N.read_raw_csv_quarantined(spark, path)
    _, bad = N.split_valid(good, N.domains(E.codes_table(spark, ws.codes)))
    both = bad.select(F.col("customerID").alias("customer_id"), "reasons").union(lines.select("key", "reasons"))
    return both.select("customer_id", F.array_join("reasons", "; ").alias("reasons"))


@query("written_splits")
def q_written_splits(spark, sf):
    """IO3: the prepared table written by split and read back."""
    from retentio.sources.files import read_split, write_splits
    path = scratch_path(spark, "splits")
    write_splits(_ws(spark, sf).prepared, path)
    return read_split(spark, path, ["train", "val", "test"]).select("customer_id", "Churn", "CLV_quartile", "split", "fold")


@query("written_metrics")
def q_written_metrics(spark, sf):
    """IO7: a metrics table written and read back (of the closed-form scores, whose metrics SQL gives too)."""
    from retentio.sources.files import write_table
    path = scratch_path(spark, "metrics")
    write_table(q_metrics(spark, sf), path)
    return spark.read.parquet(path)


@query("string_columns")
def q_string_columns(spark, sf):
    """The string features found by walking the schema, with their values counted in one pass."""
    rows = _ws(spark, sf).prepared
    names = E.string_columns(rows)
    wide = rows.agg(*[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(names)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_values")) for i, c in enumerate(names)])).alias("r")).select("r.*")


@query("clv_fallback")
def q_clv_fallback(spark, sf):
    """The value a score reports, for customers whose CLV is not known (here: the senior ones) 12 charges."""
    from retentio.functions.columns import clv_or_fallback
    rows = _ws(spark, sf).prepared.withColumn("CLV", F.when(F.col("SeniorCitizen") == 0, F.col("CLV")))
    return rows.select("customer_id", clv_or_fallback("CLV", "MonthlyCharges").alias("clv"))


@query("train_rows")
def q_train_rows(spark, sf):
    """IO2: one split read from the partitioned prepared table (folder pruning)."""
    return _ws(spark, sf).split("train")


@query("stratified_split")
def q_split(spark, sf):
    return _ws(spark, sf).prepared.select("customer_id", "Churn", "split", "fold")


@query("sample_rows")
def q_sample(spark, sf):
    return sample_rows(_ws(spark, sf).prepared.select("customer_id", "Churn", "CLV"), 200)


# --- profile and quality ------------------------------------------------------

@query("missing_profile")
def q_missing(spark, sf):
    return Q.missing_rows(_ws(spark, sf).observed("cleaned"), RAW_COLUMNS)


@query("total_conversions")
def q_conversions(spark, sf):
    """Totals that are no numbers, and what became of them."""
    return Q.conversion_rows(_ws(spark, sf).observed("cleaned"))


@query("class_balance")
def q_balance(spark, sf):
    return Q.class_rows(_ws(spark, sf).observed("prepared"))


@query("tenure_bucket_counts")
def q_bucket_counts(spark, sf):
    return Q.value_counts(_ws(spark, sf).prepared, "tenure_bucket")


@query("derived_ranges")
def q_ranges(spark, sf):
    return Q.derived_ranges(_ws(spark, sf).prepared)


@query("ratio_anomalies")
def q_anomalies(spark, sf):
    return _ws(spark, sf).observed("prepared").select("anomalies")


@query("flag_totals")
def q_flags(spark, sf):
    return Q.flag_rows(_ws(spark, sf).observed("prepared"))


@query("fiber_cut")
def q_fiber_cut(spark, sf):
    return _ws(spark, sf).cuts.select("fiber_cut")


@query("clv_cuts")
def q_clv_cuts(spark, sf):
    return _ws(spark, sf).cuts.select("clv_min", "q1", "q2", "q3", "clv_max")


@query("clv_summary")
def q_clv_summary(spark, sf):
    return R.clv_summary(_ws(spark, sf).prepared)


@query("quartile_sizes")
def q_quartile_sizes(spark, sf):
    return Q.quartile_sizes(_ws(spark, sf).prepared)


@query("quartile_churn")
def q_quartile_churn(spark, sf):
    return Q.quartile_churn(_ws(spark, sf).prepared)


@query("split_balance")
def q_split_balance(spark, sf):
    return Q.split_balance(_ws(spark, sf).prepared)


@query("balance_checks")
def q_balance_checks(spark, sf):
    return Q.balance_rows(_ws(spark, sf).observed("prepared"))


@query("class_weights")
def q_class_weights(spark, sf):
    return Q.class_weights(_ws(spark, sf).split("train"))


# --- lifetime-value reports (train + test rows) --------------------------------

@query("clv_by_churn")
def q_clv_by_churn(spark, sf):
    return R.clv_by_churn(_ws(spark, sf).report_rows())


@query("churn_by_quartile")
def q_churn_by_quartile(spark, sf):
    return R.churn_by_quartile(_ws(spark, sf).report_rows())


@query("revenue_at_risk")
def q_revenue_at_risk(spark, sf):
    return R.revenue_at_risk(_ws(spark, sf).report_rows())


@query("quartile_stats")
def q_quartile_stats(spark, sf):
    return R.quartile_stats(_ws(spark, sf).report_rows())


@query("churn_rate_by_quartile")
def q_churn_rate_by_quartile(spark, sf):
    return R.churn_rate_by_quartile(_ws(spark, sf).report_rows())


@query("quartile_extremes")
def q_quartile_extremes(spark, sf):
    return R.quartile_extremes(_ws(spark, sf).report_rows())


@query("clv_histogram")
def q_clv_histogram(spark, sf):
    return R.clv_histogram(_ws(spark, sf).report_rows())


@query("business_insights")
def q_insights(spark, sf):
    return R.business_insights(_ws(spark, sf).report_rows())


@query("retention_priority")
def q_priority(spark, sf):
    return R.retention_priority(_ws(spark, sf).prepared)


@query("priority_summary")
def q_priority_summary(spark, sf):
    return R.priority_summary(_ws(spark, sf).prepared)


@query("high_quartile_savings")
def q_savings(spark, sf):
    return R.high_quartile_savings(_ws(spark, sf).report_rows())


# --- encoding -----------------------------------------------------------------

@query("label_codes")
def q_label_codes(spark, sf):
    return E.codes_table(spark, _ws(spark, sf).codes)


@query("encoded_features")
def q_encoded(spark, sf):
    return _ws(spark, sf).encoded.select("customer_id", "split", "Churn", *K.FEATURE_COLUMNS)


# --- metrics over closed-form scores of the test rows -------------------------

def _proxy_scored(spark, sf):
    return M.proxy_scores(_ws(spark, sf).split("test"))


@query("confusion_matrix")
def q_confusion(spark, sf):
    return M.confusion_matrix(_proxy_scored(spark, sf))


@query("classification_metrics")
def q_metrics(spark, sf):
    return M.classification_metrics(_proxy_scored(spark, sf))


@query("roc_curve")
def q_roc(spark, sf):
    return M.roc_curve(_proxy_scored(spark, sf))


@query("model_comparison")
def q_comparison(spark, sf):
    return M.model_comparison(M.classification_metrics(_proxy_scored(spark, sf)), M.PROXY_BASELINE)


@query("risk_levels")
def q_risk_levels(spark, sf):
    ws = _ws(spark, sf)
    scored = M.proxy_scores(ws.split("test")).where(F.col("model") == M.PROXY_BASELINE)
    return M.risk_levels(scored).select("customer_id", "score", "risk_level")


# --- linear attributions (correlation coefficients on scaled features) --------

def _train_stats(spark, sf):
    return A.wide_stats(_ws(spark, sf).encoded.where(F.col("split") == "train"))


@query("scaler_stats")
def q_scaler_stats(spark, sf):
    return A.feature_stats(_ws(spark, sf).encoded.where(F.col("split") == "train"))


@query("linear_importance")
def q_linear_importance(spark, sf):
    return A.linear_importance(A.feature_stats(_ws(spark, sf).encoded.where(F.col("split") == "train")))


@query("linear_contributions")
def q_linear_contributions(spark, sf):
    ws = _ws(spark, sf)
    return A.linear_contributions(ws.encoded.where(F.col("split") == "test"), _train_stats(spark, sf))


@query("all_linear_contributions")
def q_all_linear_contributions(spark, sf):
    """Every customer; ``linear_contributions`` has the evaluation rows its SQL fixes."""
    return A.linear_contributions(_ws(spark, sf).encoded, _train_stats(spark, sf))


@query("all_top_factors")
def q_all_top_factors(spark, sf):
    return A.top_factors(_ws(spark, sf).encoded, _train_stats(spark, sf))


@query("all_global_contributions")
def q_all_global_contributions(spark, sf):
    return A.global_contributions(_ws(spark, sf).encoded, _train_stats(spark, sf))


@query("top_factors")
def q_top_factors(spark, sf):
    ws = _ws(spark, sf)
    return A.top_factors(ws.encoded.where(F.col("split") == "test"), _train_stats(spark, sf))


@query("first_customer_factors")
def q_first_customer(spark, sf):
    """The explanation demo on the first test customer (by key order)."""
    ws = _ws(spark, sf)
    first = ws.split("test").select("customer_id").orderBy("customer_id").limit(1)
    rows = ws.encoded.where(F.col("split") == "test").join(first, "customer_id", "left_semi")
    return A.top_factors(rows, _train_stats(spark, sf))


@query("global_contributions")
def q_global_contributions(spark, sf):
    ws = _ws(spark, sf)
    return A.global_contributions(ws.encoded.where(F.col("split") == "test"), _train_stats(spark, sf))


# --- trained models (no SQL oracle: iterative fits; rows checked) -------------

MODEL_SCORES = ("logistic", "random_forest", "boosted")


def _scored_test(spark, sf):
    from retentio.ml.scoring import score
    ws = _ws(spark, sf)
    return score(ws.split("test"), ws.model(), keep=("customer_id", "Churn"))


def _long_scores(scored):
    items = [F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("score")) for m in MODEL_SCORES]
    items.append(F.struct(F.lit("ensemble").alias("model"), F.col("churn_probability").alias("score")))
    return scored.select("customer_id", F.col("Churn").alias("label"), F.explode(F.array(*items)).alias("s")).select(
        "customer_id", "s.model", "label", "s.score")


@query("scored_customers")
def q_scored(spark, sf):
    """Every customer, not only the evaluation rows."""
    from retentio.ml.scoring import score
    ws = _ws(spark, sf)
    return score(ws.prepared, ws.model(), keep=("customer_id", "Churn"))


@query("model_metrics")
def q_model_metrics(spark, sf):
    counts = M.score_counts(_long_scores(_scored_test(spark, sf)))  # one pass over scored rows
    return M.classification_metrics(counts).join(M.confusion_matrix(counts), "model")


@query("model_comparison_trained")
def q_model_comparison_trained(spark, sf):
    long = _long_scores(_scored_test(spark, sf)).where(F.col("model") != "ensemble")
    return M.model_comparison(M.classification_metrics(long), "logistic")


@query("model_roc_curve")
def q_model_roc(spark, sf):
    return M.roc_curve(_long_scores(_scored_test(spark, sf)))


@query("high_risk_check")
def q_high_risk(spark, sf):
    from retentio.ml.scoring import high_risk_check
    return high_risk_check(spark, _ws(spark, sf).model(), _ws(spark, sf).fitted_cut())


def _search(spark, sf):
    # a row per model, point and fold: 125 rows at any size of the input
    mean = F.avg("auc").over(Window.partitionBy("model", "point"))
    return _ws(spark, sf).search("reference").withColumn("mean_auc", mean)


@query("grid_search")
def q_grid_search(spark, sf):
    """Exact AUC on the held-out fold of every point of the published grids, and the chosen points."""
    return _search(spark, sf).select("model", "point", "fold", "auc", "mean_auc", "chosen")


@query("grid_folds")
def q_grid_folds(spark, sf):
    """The points of the grids with the rows and positives each fit and each measurement had."""
    in_range = F.col("auc").between(0.0, 1.0) & F.col("mean_auc").between(0.0, 1.0)
    best = F.max("mean_auc").over(Window.partitionBy("model"))  # as small as the search
    return _search(spark, sf).select("model", "point", "fold", "n_fit", "n_held", "fit_positives", "held_positives",
                                     in_range.alias("auc_in_range"), (~F.col("chosen") | (F.col("mean_auc") == best)).alias("chosen_is_best"))


@query("tree_importance")
def q_tree_importance(spark, sf):
    from retentio.ml.explain import tree_importance_frame
    return tree_importance_frame(spark, _ws(spark, sf).trained())


@query("logistic_importance")
def q_logistic_importance(spark, sf):
    from retentio.ml.explain import logistic_importance
    return logistic_importance(spark, _ws(spark, sf).trained())


@query("logistic_top_factors")
def q_logistic_top_factors(spark, sf):
    from retentio.ml.explain import logistic_stats_row
    ws = _ws(spark, sf)
    stats = logistic_stats_row(spark, ws.trained())
    return A.top_factors(ws.encoded, stats)


def _explained(spark, sf, name):
    """Factors of one model beside its own scores, every customer, in one projection."""
    from retentio.ml import explain as X
    from retentio.ml.scoring import score
    ws = _ws(spark, sf)
    rows = score(ws.prepared, ws.model(), features=True)
    own = f"p_{name}"
    if name == "logistic":
        factors = X.logistic_explanations(rows, X.logistic_stats_row(spark, ws.trained()), carry=(own, "clv"))
    else:
        factors = X.tree_explanations(rows, ws.trained(), name, carry=(own, "clv"))
    return X.explanation(factors, own, X.fallback_array(ws.trained(), name))


@query("logistic_explanations")
def q_logistic_explanations(spark, sf):
    return _explained(spark, sf, "logistic")


@query("boosted_explanations")
def q_boosted_explanations(spark, sf):
    return _explained(spark, sf, "boosted")


@query("forest_explanations")
def q_forest_explanations(spark, sf):
    return _explained(spark, sf, "random_forest")


@query("model_scores")
def q_model_scores(spark, sf):
    """Every customer scored by each model and by their mean, each with its own risk level."""
    from retentio.functions.columns import risk_level
    long = q_scored(spark, sf)
    items = [F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p")) for m in MODEL_SCORES]
    items.append(F.struct(F.lit("ensemble").alias("model"), F.col("churn_probability").alias("p")))
    each = long.select("customer_id", "clv", "expected_tenure", F.explode(F.array(*items)).alias("s"))
    return each.select("customer_id", "s.model", F.col("s.p").alias("churn_probability"), risk_level(F.col("s.p")).alias("risk_level"), "clv", "expected_tenure")


@query("score_checks")
def q_score_checks(spark, sf):
    """What must hold for every customer's scores, whatever the fit: ranges, the mean, the risk level, the value."""
    scored = q_scored(spark, sf)
    ps = [F.col(f"p_{m}") for m in MODEL_SCORES]
    mean = F.col("churn_probability")
    level = F.when(mean < 0.3, "Low").when(mean < 0.6, "Medium").otherwise("High")
    in_range = F.lit(True)
    for p in [*ps, mean]:
        in_range = in_range & p.between(0.0, 1.0)
    return scored.select(
        "customer_id", in_range.alias("in_range"), (F.abs(mean - (ps[0] + ps[1] + ps[2]) / 3) < 1e-12).alias("is_mean"),
        (F.col("risk_level") == level).alias("level_fits"), "clv", "expected_tenure")


def _additivity(spark, sf, name):
    from retentio.ml import explain as X
    from retentio.ml.scoring import score
    from retentio.ml.treeshap import attributions
    ws = _ws(spark, sf)
    own = f"p_{name}"
    rows = score(ws.prepared, ws.model(), features=True)
    att = attributions(rows, ws.trained().models[name], X._kind(name), carry=(own,), nodes=ws.trained().nodes[name])
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    p = F.col("output") if name == "random_forest" else F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("output")))
    near = lambda a, b: F.abs(a - b) < 1e-9
    return att.select("customer_id", F.lit(name).alias("model"), near(total, F.col("output")).alias("adds_up"), near(p, F.col(own)).alias("gives_score"))


@query("explanation_checks")
def q_explanation_checks(spark, sf):
    """For every customer and tree model, base and contributions add up to the output, and that to the score."""
    return _additivity(spark, sf, "boosted").union(_additivity(spark, sf, "random_forest"))


@query("forest_global_attribution")
def q_forest_global(spark, sf, rows: int | None = None):
    """L16 over every training row, or over a sample of ``rows`` of them (the reference takes 100)."""
    return _global_attribution(spark, sf, "random_forest", rows)


@query("boosted_global_attribution")
def q_boosted_global(spark, sf, rows: int | None = None):
    """L16 for the boosted model, the reference's default."""
    return _global_attribution(spark, sf, "boosted", rows)


def _global_attribution(spark, sf, name, rows):
    from retentio.ml.explain import global_tree_attribution
    ws = _ws(spark, sf)
    train = ws.split("train")
    sample = train if rows is None else sample_rows(train, rows)
    feats = ws.trained().features.transform(sample).select("customer_id", "features")
    return global_tree_attribution(feats, ws.trained(), name)


def _fixed(spark, sf):
    from retentio.ml import fixed_trees as T
    from retentio.ml.nodes import write_nodes
    ws = _ws(spark, sf)
    nodes = write_nodes(T.node_table(ws.encoded.where(F.col("split") == "train")), scratch_path(spark, "fixed-trees"))
    return T.explained(ws.encoded, nodes)


@query("fixed_tree_scores")
def q_fixed_scores(spark, sf):
    """A fixed ensemble held as a node relation, scored for every customer."""
    return _fixed(spark, sf).select("customer_id", F.round("base_value", 6).alias("base_value"), F.round("output", 6).alias("output"))


@query("fixed_tree_contributions")
def q_fixed_contributions(spark, sf):
    """Its exact contributions, of the features it uses."""
    from retentio.ml import fixed_trees as T
    from retentio.ml.treeshap import contribution_structs
    used = {x.feature for tree in T.TREES for _, path in T.leaves(tree) for x, _ in path}
    each = _fixed(spark, sf).select("customer_id", F.explode(contribution_structs(F.col("contributions"))).alias("c"))
    # adding 0.0 turns a negative zero into zero
    return each.where(F.col("c.feature").isin(sorted(used))).select("customer_id", "c.feature", (F.round("c.contribution", 6) + F.lit(0.0)).alias("contribution"))


@query("importance_fallback")
def q_importance_fallback(spark, sf):
    from retentio.ml.explain import importance_factors
    return importance_factors(spark, _ws(spark, sf).trained(), "random_forest")


@query("stream_scores")
def q_stream_scores(spark, sf):
    from retentio.functions.columns import to_number
    from retentio.schema import SCORING_REQUEST
    from retentio.streaming.scoring import score_files_once
    ws = _ws(spark, sf)
    raw = ws.raw
    requests = raw.select(
        F.col("customerID").alias("customer_id"),
        *[F.col(f.name) for f in SCORING_REQUEST.fields[1:] if f.name != "TotalCharges"],
        to_number("TotalCharges").alias("TotalCharges"),
    ).select(*[f.name for f in SCORING_REQUEST.fields])
    source = scratch_path(spark, "stream-requests")
    requests.write.parquet(source)
    return score_files_once(spark, source, ws.model(), cut=ws.fitted_cut())


@query("stream_rejects")
def q_stream_rejects(spark, sf):
    """A request stream with unknown and missing values; bad requests are set aside, all others scored once."""
    from retentio.functions.columns import to_number
    from retentio.schema import SCORING_REQUEST
    from retentio.sources.quarantine import domains
    from retentio.streaming.scoring import request_stream
    from retentio.streaming.sink import read_committed, scoring_work, start_batches
    ws = _ws(spark, sf)
    k = F.col("customer_id").cast("long")
    requests = ws.raw.withColumnRenamed("customerID", "customer_id").withColumns({
        "TotalCharges": to_number("TotalCharges"),
        "PaymentMethod": F.when(k % 50 == 3, "Cheque").otherwise(F.col("PaymentMethod")),
        "tenure": F.when(k % 70 != 5, F.col("tenure")),
    }).select(*[f.name for f in SCORING_REQUEST.fields])
    source, sink = scratch_path(spark, "requests"), scratch_path(spark, "stream-sink")
    requests.write.parquet(source)
    known = domains(E.codes_table(spark, ws.codes))
    work = scoring_work(ws.model(), known, ws.fitted_cut())
    start_batches(request_stream(spark, source, max_files_per_trigger=1), sink, work).awaitTermination()
    scored = read_committed(spark, sink).select("customer_id", F.lit("").alias("reasons"))
    bad = read_committed(spark, sink, "rejected").select("customer_id", F.array_join("reasons", "; ").alias("reasons"))
    return scored.union(bad)


@query("stream_vs_batch")
def q_stream_vs_batch(spark, sf):
    """Every customer scored by the stream and from the prepared table: the scores agree."""
    names = [f"p_{m}" for m in MODEL_SCORES] + ["churn_probability"]
    streamed = q_stream_scores(spark, sf).select("customer_id", *[F.col(n).alias(f"s_{n}") for n in names])
    batch = q_scored(spark, sf).select("customer_id", *names)
    same = F.lit(True)
    for n in names:
        same = same & F.coalesce(F.abs(F.col(n) - F.col(f"s_{n}")) < 1e-12, F.lit(False))
    return batch.join(streamed, "customer_id", "full").select("customer_id", same.alias("same_scores"))
