"""DuckDB SQL for every registered query that has an exact oracle.

Written against the shared CTEs of ``base_sql`` (raw, clean, feat, cuts,
prep, split, prep_split). Fixed-point sums and half-even rounding are
spelled out the same way the Spark side computes them.
"""

from __future__ import annotations

import math

from retentio.ml.fixed_trees import SCALE, TREES, leaves
from verification.base_sql import with_base

# --- fixed values: column names, labels and sentences that queries and SQL share ---
RAW_COLS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
            "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
            "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
            "MonthlyCharges", "TotalCharges", "Churn"]


def esum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(20,6))) AS DOUBLE)"


def eavg(x: str) -> str:
    return f"({esum(x)} / COUNT({x}))"


def estd(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"
    s1 = f"CAST(SUM(CAST({d} AS DECIMAL(20,6))) AS DOUBLE)"
    s2 = f"CAST(SUM(CAST({d} * {d} AS DECIMAL(26,6))) AS DOUBLE)"
    n = f"CAST(COUNT({x}) AS DOUBLE)"
    var = f"(CASE WHEN {n} > 1 THEN ({s2} - {s1} * {s1} / {n}) / ({n} - 1) END)"
    return f"sqrt(CASE WHEN {var} < 0 THEN 0e0 ELSE {var} END)"


def rate(x: str) -> str:
    return f"avg(CAST({x} AS DOUBLE))"


def r(x: str, d: int = 2) -> str:
    s = f"{10 ** d}e0"
    return f"(round_even(({x}) * {s}, 0) / {s})"


REPORT = "(SELECT * FROM prep_split WHERE split IN ('train', 'test'))"
LABELS = "(VALUES ('Low', 0), ('Medium', 1), ('High', 2), ('Premium', 3)) AS lab(CLV_quartile, q_rank)"

SQL: dict[str, str] = {}

SQL["subscribers_raw"] = "SELECT * FROM raw"
SQL["clean_subscribers"] = "SELECT * FROM clean"
SQL["subscriber_features"] = "SELECT * FROM prep"
SQL["serving_features"] = """
SELECT q.*,
  CASE WHEN tenure <= 6 THEN '0-6m' WHEN tenure <= 12 THEN '6-12m'
       WHEN tenure <= 24 THEN '12-24m' ELSE '24m+' END AS tenure_bucket,
  (CASE WHEN PhoneService = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN InternetService IN ('DSL', 'Fiber optic') THEN 1 ELSE 0 END)
  + (CASE WHEN OnlineSecurity = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN OnlineBackup = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN DeviceProtection = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN TechSupport = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN StreamingTV = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN StreamingMovies = 'Yes' THEN 1 ELSE 0 END) AS services_count,
  TotalCharges / greatest(1e0, tenure * MonthlyCharges) AS monthly_to_total_ratio,
  CASE WHEN InternetService IN ('DSL', 'Fiber optic') AND TechSupport = 'No' THEN 1 ELSE 0 END
    AS flag_internet_no_tech_support,
  CASE WHEN InternetService = 'Fiber optic' AND MonthlyCharges > 70e0 THEN 1 ELSE 0 END
    AS flag_fiber_high_charges,
  CASE WHEN tenure <= 12 AND Contract = 'Month-to-month' THEN 1 ELSE 0 END AS flag_short_tenure_monthly,
  CASE WHEN Contract IN ('One year', 'Two year') THEN 24 ELSE 12 END AS expected_tenure,
  MonthlyCharges * (CASE WHEN Contract IN ('One year', 'Two year') THEN 24 ELSE 12 END) AS CLV
FROM (
  SELECT customerID AS customer_id, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService,
    MultipleLines, InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport,
    StreamingTV, StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges,
    COALESCE(CASE WHEN regexp_matches(TotalCharges, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
                  THEN TRY_CAST(trim(TotalCharges) AS DOUBLE) END,
             tenure * MonthlyCharges) AS TotalCharges
  FROM raw) q
"""
SQL["subscribers_csv"] = "SELECT * FROM clean"
SQL["train_rows"] = "SELECT * FROM prep_split WHERE split = 'train'"
SQL["stratified_split"] = "SELECT customer_id, Churn, split, fold FROM split"
SQL["sample_rows"] = """
SELECT customer_id, Churn, CLV FROM prep ORDER BY md5('42:' || customer_id), customer_id LIMIT 200
"""

SQL["missing_profile"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing, "
    f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100e0 / COUNT(*) AS missing_pct FROM raw"
    for c in RAW_COLS
)
SQL["class_balance"] = f"""
SELECT COUNT(*) AS n_rows, CAST(SUM(Churn) AS BIGINT) AS churned, {rate('Churn')} AS churn_rate,
  ({rate('Churn')} < 0.15e0 OR {rate('Churn')} > 0.40e0) AS imbalanced
FROM prep
"""
SQL["tenure_bucket_counts"] = "SELECT tenure_bucket, COUNT(*) AS n FROM prep GROUP BY tenure_bucket"
SQL["derived_ranges"] = "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, CAST(MIN({f}) AS DOUBLE) AS min_value, CAST(MAX({f}) AS DOUBLE) AS max_value, "
    f"{eavg(f)} AS mean_value FROM prep"
    for f in ["services_count", "monthly_to_total_ratio"]
)
SQL["ratio_anomalies"] = """
SELECT COUNT(*) FILTER (WHERE monthly_to_total_ratio > 1.5e0 OR monthly_to_total_ratio < 0.5e0) AS anomalies
FROM prep
"""
SQL["flag_totals"] = "\nUNION ALL\n".join(
    f"SELECT '{f}' AS flag, CAST(SUM({f}) AS BIGINT) AS customers FROM prep"
    for f in ["flag_internet_no_tech_support", "flag_fiber_high_charges", "flag_short_tenure_monthly"]
)
SQL["fiber_cut"] = "SELECT quantile_cont(MonthlyCharges, 0.75) AS fiber_cut FROM clean"
SQL["clv_cuts"] = """
SELECT MIN(CLV) AS clv_min, quantile_cont(CLV, 0.25) AS q1, quantile_cont(CLV, 0.5) AS q2,
       quantile_cont(CLV, 0.75) AS q3, MAX(CLV) AS clv_max
FROM feat
"""
SQL["clv_summary"] = f"""
SELECT MIN(CLV) AS min_clv, MAX(CLV) AS max_clv, {eavg('CLV')} AS mean_clv, {esum('CLV')} AS total_clv,
       quantile_cont(CLV, 0.5) AS median_clv
FROM prep
"""
SQL["quartile_sizes"] = f"""
SELECT CLV_quartile, COUNT(*) AS n, {eavg('CLV')} AS mean_clv
FROM prep WHERE CLV_quartile IS NOT NULL GROUP BY CLV_quartile
"""
SQL["quartile_churn"] = f"""
SELECT CLV_quartile, {rate('Churn')} AS churn_rate, COUNT(*) AS n
FROM prep WHERE CLV_quartile IS NOT NULL GROUP BY CLV_quartile
"""
SQL["split_balance"] = f"""
WITH per AS (
  SELECT split, COUNT(*) AS n, CAST(SUM(Churn) AS BIGINT) AS churned, {rate('Churn')} AS churn_rate
  FROM prep_split GROUP BY split),
ov AS (SELECT {rate('Churn')} AS overall_rate FROM prep_split),
g AS (SELECT per.*, ov.overall_rate, abs(churn_rate - overall_rate) * 100e0 AS gap_points FROM per CROSS JOIN ov)
SELECT g.*, m.max_gap_points, m.max_gap_points < 2e0 AS stratified_ok
FROM g CROSS JOIN (SELECT MAX(gap_points) AS max_gap_points FROM g) m
"""
SQL["balance_checks"] = f"""
SELECT 'churn_rate_in_band' AS check_name, {rate('Churn')} AS value,
       ({rate('Churn')} >= 0.15e0 AND {rate('Churn')} <= 0.40e0) AS passed FROM prep_split
UNION ALL
SELECT 'train_rate_needs_no_weighting', {rate('Churn')}, {rate('Churn')} >= 0.30e0
FROM prep_split WHERE split = 'train'
"""
SQL["class_weights"] = """
WITH t AS (SELECT * FROM prep_split WHERE split = 'train'),
tot AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE Churn = 1) AS pos,
               COUNT(*) FILTER (WHERE Churn = 0) AS neg FROM t)
SELECT c.Churn, c.n, CAST(tot.total AS DOUBLE) / (2e0 * c.n) AS balanced_weight,
       CASE WHEN c.Churn = 1 THEN CAST(tot.neg AS DOUBLE) / tot.pos ELSE 1e0 END AS boost_weight
FROM (SELECT Churn, COUNT(*) AS n FROM t GROUP BY Churn) c CROSS JOIN tot
"""

SQL["clv_by_churn"] = f"""
WITH rr AS {REPORT},
st AS (SELECT Churn, {eavg('CLV')} AS mean_clv, quantile_cont(CLV, 0.5) AS median_clv,
              {estd('CLV')} AS std_clv, COUNT(CLV) AS n FROM rr GROUP BY Churn)
SELECT s.status, {r('st.mean_clv')} AS mean_clv, {r('st.median_clv')} AS median_clv,
       {r('st.std_clv')} AS std_clv, COALESCE(st.n, 0) AS n
FROM (VALUES (0, 'Not Churned'), (1, 'Churned')) AS s(Churn, status) LEFT JOIN st USING (Churn)
"""
SQL["churn_by_quartile"] = f"""
WITH rr AS {REPORT},
a AS (SELECT CLV_quartile, {rate('Churn')} AS rt, CAST(SUM(Churn) AS BIGINT) AS churned, COUNT(*) AS total,
             {eavg('CLV')} AS av, MIN(CLV) AS mn, MAX(CLV) AS mx
      FROM rr WHERE CLV_quartile IS NOT NULL GROUP BY CLV_quartile)
SELECT lab.CLV_quartile, {r(r('a.rt') + ' * 100e0', 1)} AS churn_rate, a.churned, a.total,
       {r('a.av')} AS avg_clv, {r('a.mn')} AS min_clv, {r('a.mx')} AS max_clv
FROM {LABELS} LEFT JOIN a USING (CLV_quartile)
"""
SQL["revenue_at_risk"] = f"""
WITH rr AS {REPORT},
a AS (SELECT {esum('CLV')} AS total_clv,
             {esum('CASE WHEN Churn = 1 THEN CLV END')} AS churned_clv,
             {esum('CASE WHEN Churn = 0 THEN CLV END')} AS retained_clv,
             {eavg('CASE WHEN Churn = 1 THEN CLV END')} AS avg_churned_clv,
             {eavg('CASE WHEN Churn = 0 THEN CLV END')} AS avg_retained_clv FROM rr)
SELECT total_clv, churned_clv, retained_clv, churned_clv / total_clv * 100e0 AS revenue_at_risk_pct,
       avg_churned_clv, avg_retained_clv FROM a
"""
SQL["quartile_stats"] = f"""
WITH rr AS {REPORT}
SELECT CLV_quartile,
  '$' || CAST(CAST(round_even({r(eavg('CLV'))}, 0) AS BIGINT) AS VARCHAR) AS avg_clv,
  CAST({r(r(rate('Churn')) + ' * 100e0', 1)} AS VARCHAR) || '%' AS churn_rate,
  COUNT(*) AS n
FROM rr WHERE CLV_quartile IS NOT NULL GROUP BY CLV_quartile
"""
SQL["churn_rate_by_quartile"] = f"""
WITH rr AS {REPORT},
a AS (SELECT CLV_quartile, {rate('Churn')} * 100e0 AS churn_rate_pct FROM rr
      WHERE CLV_quartile IS NOT NULL GROUP BY CLV_quartile)
SELECT lab.CLV_quartile, a.churn_rate_pct FROM {LABELS} LEFT JOIN a USING (CLV_quartile)
"""
_RATES = f"""
WITH rr AS {REPORT},
rates AS (SELECT a.CLV_quartile, a.rate, lab.q_rank FROM
  (SELECT CLV_quartile, {rate('Churn')} * 100e0 AS rate FROM rr WHERE CLV_quartile IS NOT NULL
   GROUP BY CLV_quartile) a JOIN {LABELS} USING (CLV_quartile)),
ext AS (SELECT
  (SELECT CLV_quartile FROM rates ORDER BY rate DESC, q_rank LIMIT 1) AS worst_quartile,
  (SELECT MAX(rate) FROM rates) AS worst_rate_pct,
  (SELECT CLV_quartile FROM rates ORDER BY rate ASC, q_rank LIMIT 1) AS best_quartile,
  (SELECT MIN(rate) FROM rates) AS best_rate_pct)
"""
SQL["quartile_extremes"] = _RATES + "SELECT * FROM ext"
SQL["clv_histogram"] = f"""
WITH rr AS {REPORT},
rng AS (SELECT MIN(CLV) AS lo, MAX(CLV) AS hi FROM rr),
b AS (SELECT CASE WHEN hi - lo = 0 THEN 1
                  ELSE CAST(LEAST(30, 1 + FLOOR((CLV - lo) * 30e0 / (hi - lo))) AS INTEGER) END AS bin
      FROM rr CROSS JOIN rng WHERE CLV IS NOT NULL),
c AS (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin),
e AS (SELECT CAST(i AS INTEGER) AS bin, lo + (hi - lo) * CAST(i - 1 AS DOUBLE) / 30e0 AS lo,
             lo + (hi - lo) * CAST(i AS DOUBLE) / 30e0 AS hi
      FROM range(1, 31) t(i) CROSS JOIN rng)
SELECT e.bin, e.lo, e.hi, COALESCE(c.n, 0) AS n FROM e LEFT JOIN c USING (bin)
"""
SQL["business_insights"] = _RATES + f""",
risk AS (SELECT {esum('CASE WHEN Churn = 1 THEN CLV END')} AS churned_clv, {esum('CLV')} AS total_clv FROM rr)
SELECT 1 AS insight, printf('🚨 CRITICAL: %s CLV customers have the highest churn rate at %.1f%%. These customers are paying premium prices but are dissatisfied - prioritize retention efforts here.', worst_quartile, {r('worst_rate_pct', 1)}) AS text FROM ext
UNION ALL
SELECT 2, printf('✅ %s CLV customers have the lowest churn rate at %.1f%%. These are typically long-term contract customers - contract lock-in is working.', best_quartile, {r('best_rate_pct', 1)}) FROM ext
UNION ALL
SELECT 3, printf('💰 %.1f%% of total CLV ($%s) is at risk from churning customers.', {r('churned_clv / total_clv * 100e0', 1)}, format('{{:,.0f}}', round_even(churned_clv, 0))) FROM risk
"""
_PRIORITY = """
SELECT customer_id, CLV_quartile, Contract, CLV, Churn,
  CASE WHEN CLV_quartile = 'High' AND Contract = 'Month-to-month' THEN 'Retain'
       WHEN CLV_quartile = 'Medium' AND Contract = 'Month-to-month' THEN 'Monitor'
       WHEN CLV_quartile = 'Premium' AND Contract IN ('One year', 'Two year') THEN 'Nurture'
       ELSE 'Other' END AS priority,
  (CASE WHEN InternetService = 'Fiber optic' THEN 1 ELSE 0 END)
  + (CASE WHEN TechSupport = 'No' THEN 1 ELSE 0 END)
  + (CASE WHEN PaymentMethod = 'Electronic check' THEN 1 ELSE 0 END)
  + (CASE WHEN tenure < 12 THEN 1 ELSE 0 END)
  + (CASE WHEN SeniorCitizen = 1 THEN 1 ELSE 0 END) AS signals
FROM prep
"""
SQL["retention_priority"] = _PRIORITY
SQL["priority_summary"] = f"""
SELECT priority, COUNT(*) AS customers, CAST(SUM(Churn) AS BIGINT) AS churned, {esum('CLV')} AS total_clv,
       {rate('Churn')} AS churn_rate
FROM ({_PRIORITY}) p GROUP BY priority
"""
SQL["high_quartile_savings"] = f"""
WITH rr AS {REPORT},
a AS (SELECT {esum("CASE WHEN CLV_quartile = 'High' AND Churn = 1 THEN CLV END")} AS high_churned_clv FROM rr)
SELECT high_churned_clv, high_churned_clv * 0.1e0 AS savings FROM a
"""



# --- encoding, metrics and linear attributions ----------------------------------

FEATURES = ["gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService", "MultipleLines",
            "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
            "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
            "MonthlyCharges", "TotalCharges", "tenure_bucket", "services_count", "monthly_to_total_ratio",
            "flag_internet_no_tech_support", "flag_fiber_high_charges", "flag_short_tenure_monthly",
            "expected_tenure", "CLV"]
STRINGS = ["gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
           "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
           "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod", "tenure_bucket"]

_ENC_COLS = ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {f}) - 1 AS INTEGER) AS {f}" if f in STRINGS else f for f in FEATURES
)
ENC = f"enc AS (SELECT customer_id, split, Churn, {_ENC_COLS} FROM prep_split)"

SQL["label_codes"] = "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{f}' AS column_name, {f} AS value, "
    f"CAST(dense_rank() OVER (ORDER BY {f}) - 1 AS INTEGER) AS code FROM prep"
    for f in STRINGS
)
SQL["encoded_features"] = f"WITH {ENC} SELECT * FROM enc"

SCORED = """sc AS (
  SELECT customer_id, Churn AS label, m.model,
    CASE m.model WHEN 'proxy_tenure_cycle' THEN CAST(tenure % 20 AS DOUBLE) / 20e0
                 WHEN 'proxy_services' THEN CAST(services_count AS DOUBLE) / 9e0
                 ELSE 1e0 - CAST(LEAST(tenure, 72) AS DOUBLE) / 72e0 END AS score
  FROM prep_split CROSS JOIN (VALUES ('proxy_tenure_cycle'), ('proxy_services'), ('proxy_tenure')) m(model)
  WHERE split = 'test')"""
CONF = """cm AS (
  SELECT model,
    COUNT(*) FILTER (WHERE label = 0 AND NOT score > 0.5e0) AS tn,
    COUNT(*) FILTER (WHERE label = 0 AND score > 0.5e0) AS fp,
    COUNT(*) FILTER (WHERE label = 1 AND NOT score > 0.5e0) AS fn,
    COUNT(*) FILTER (WHERE label = 1 AND score > 0.5e0) AS tp
  FROM sc GROUP BY model)"""
BELOW = """cnt AS (
  SELECT model, score, CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
  FROM sc GROUP BY model, score),
blw AS (
  SELECT model, score, pos, neg,
    COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
    COALESCE(SUM(pos) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below
  FROM cnt)"""
METRICS = f"""{CONF},
{BELOW},
auc AS (
  SELECT model, CAST(SUM(pos * (2 * neg_below + neg)) AS DOUBLE)
         / (2e0 * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) AS auc_roc
  FROM blw GROUP BY model),
mt AS (
  SELECT cm.model,
    CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (CAST(tp AS DOUBLE) + CAST(fp AS DOUBLE)) ELSE 0e0 END AS precision,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (CAST(tp AS DOUBLE) + CAST(fn AS DOUBLE)) ELSE 0e0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0
         THEN 2 * CAST(tp AS DOUBLE) / (2 * CAST(tp AS DOUBLE) + CAST(fp AS DOUBLE) + CAST(fn AS DOUBLE))
         ELSE 0e0 END AS f1,
    auc.auc_roc
  FROM cm JOIN auc USING (model))"""

SQL["confusion_matrix"] = f"WITH {SCORED},\n{CONF}\nSELECT * FROM cm"
SQL["classification_metrics"] = f"WITH {SCORED},\n{METRICS}\nSELECT *, recall >= 0.6e0 AS recall_ok FROM mt"
SQL["roc_curve"] = f"""WITH {SCORED},
{BELOW},
tot AS (SELECT model, SUM(pos) AS P, SUM(neg) AS N FROM cnt GROUP BY model)
SELECT blw.model, score AS threshold,
  CAST(N - neg_below AS DOUBLE) / CAST(N AS DOUBLE) AS fpr,
  CAST(P - pos_below AS DOUBLE) / CAST(P AS DOUBLE) AS tpr
FROM blw JOIN tot USING (model)
UNION ALL
SELECT model, NULL, 0e0, 0e0 FROM tot"""
SQL["model_comparison"] = f"""WITH {SCORED},
{METRICS}
SELECT model, precision, recall, f1, auc_roc,
  model = (SELECT model FROM mt ORDER BY auc_roc DESC, model LIMIT 1) AS is_best,
  CASE WHEN model = 'proxy_tenure_cycle' THEN NULL
       ELSE auc_roc > (SELECT auc_roc FROM mt WHERE model = 'proxy_tenure_cycle') END AS beats_baseline
FROM mt"""
SQL["risk_levels"] = f"""WITH {SCORED}
SELECT customer_id, score,
  CASE WHEN score < 0.3e0 THEN 'Low' WHEN score < 0.6e0 THEN 'Medium' ELSE 'High' END AS risk_level
FROM sc WHERE model = 'proxy_tenure_cycle'"""


def _sums(i: int, f: str) -> str:
    d = f"CAST({f} AS DOUBLE)"
    return (f"CAST(SUM(CAST({d} AS DECIMAL(20,6))) AS DOUBLE) AS sx{i}, "
            f"CAST(SUM(CAST({d} * {d} AS DECIMAL(26,6))) AS DOUBLE) AS sxx{i}, "
            f"CAST(SUM(CAST({d} * CAST(Churn AS DOUBLE) AS DECIMAL(26,6))) AS DOUBLE) AS sxy{i}")


def _stat_cols(i: int) -> str:
    vs = f"((sxx{i} - sx{i} * sx{i} / n) / (n - 1))"
    vp = f"((sxx{i} - sx{i} * sx{i} / n) / n)"
    vx = f"(n * sxx{i} - sx{i} * sx{i})"
    vy = "(n * syy - sy * sy)"
    cov = f"(n * sxy{i} - sx{i} * sy)"
    return (f"sx{i} / n AS m{i}, sqrt(CASE WHEN {vs} < 0 THEN 0e0 ELSE {vs} END) AS s{i}, "
            f"sqrt(CASE WHEN {vp} < 0 THEN 0e0 ELSE {vp} END) AS sp{i}, "
            f"CASE WHEN {vx} * {vy} > 0 THEN {cov} / sqrt({vx} * {vy}) ELSE 0e0 END AS c{i}")


STATS = (
    f"{ENC},\nmom AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, "
    f"CAST(SUM(CAST(CAST(Churn AS DOUBLE) AS DECIMAL(20,6))) AS DOUBLE) AS sy, "
    f"CAST(SUM(CAST(CAST(Churn AS DOUBLE) * CAST(Churn AS DOUBLE) AS DECIMAL(26,6))) AS DOUBLE) AS syy, "
    + ", ".join(_sums(i, f) for i, f in enumerate(FEATURES))
    + " FROM enc WHERE split = 'train'),\nst AS (SELECT "
    + ", ".join(_stat_cols(i) for i in range(len(FEATURES)))
    + " FROM mom)"
)
STATS_LONG = "fs AS (" + "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{f}' AS feature, m{i} AS mean, s{i} AS std_samp, sp{i} AS std_pop, "
    f"c{i} AS correlation FROM st"
    for i, f in enumerate(FEATURES)
) + ")"


def _contributions(rows: str) -> str:
    return "lc AS (" + "\nUNION ALL\n".join(
    f"SELECT customer_id, {i} AS position, '{f}' AS feature, "
    f"CASE WHEN s{i} > 0 THEN (CAST({f} AS DOUBLE) - m{i}) / s{i} ELSE 0e0 END AS value, c{i} AS coefficient, "
    f"c{i} * (CASE WHEN s{i} > 0 THEN (CAST({f} AS DOUBLE) - m{i}) / s{i} ELSE 0e0 END) AS contribution "
    f"FROM enc CROSS JOIN st WHERE {rows}"
    for i, f in enumerate(FEATURES)
    ) + ")"


CONTRIB = _contributions("split = 'test'")
ALL_CONTRIB = _contributions("TRUE")

SQL["scaler_stats"] = f"WITH {STATS},\n{STATS_LONG}\nSELECT * FROM fs"
SQL["linear_importance"] = f"""WITH {STATS},
{STATS_LONG}
SELECT feature, correlation AS coefficient, std_pop AS std_dev, abs(correlation * std_pop) AS importance,
  CAST(row_number() OVER (ORDER BY abs(correlation * std_pop) DESC, position) AS INTEGER) AS importance_rank
FROM fs"""
SQL["linear_contributions"] = f"""WITH {STATS},
{CONTRIB}
SELECT customer_id, feature, value, coefficient, contribution, abs(contribution) AS abs_contribution FROM lc"""
SQL["top_factors"] = f"""WITH {STATS},
{CONTRIB},
rk AS (SELECT customer_id, feature, contribution,
         CAST(row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, position) AS INTEGER) AS factor_rank
       FROM lc)
SELECT customer_id, factor_rank, feature, abs(contribution) AS weight,
  CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END AS direction
FROM rk WHERE factor_rank <= 5"""
SQL["first_customer_factors"] = f"""WITH {STATS},
{CONTRIB},
rk AS (SELECT customer_id, feature, contribution,
         CAST(row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, position) AS INTEGER) AS factor_rank
       FROM lc WHERE customer_id = (SELECT customer_id FROM prep_split WHERE split = 'test'
                                    ORDER BY customer_id LIMIT 1))
SELECT customer_id, factor_rank, feature, abs(contribution) AS weight,
  CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END AS direction
FROM rk WHERE factor_rank <= 5"""

def _points() -> list[tuple[str, str]]:
    out = [("logistic", f"c={c}") for c in ("0.01", "0.1", "1.0", "10.0")]
    out += [("random_forest", f"depth={d}, min_leaf={n}") for d in (5, 10, 15, 30) for n in (1, 2, 4)]
    return out + [("boosted", f"depth={d}, rate={r}") for d in (3, 5, 7) for r in ("0.01", "0.1", "0.2")]


SQL["grid_folds"] = f"""
WITH pt(model, point) AS (VALUES {", ".join(f"('{m}', '{p}')" for m, p in _points())}),
fd(fold) AS (SELECT CAST(range AS INTEGER) FROM range(5)),
tr AS (SELECT fold, Churn FROM split WHERE split = 'train'),
sz AS (
  SELECT fd.fold, COUNT(*) FILTER (WHERE tr.fold <> fd.fold) AS n_fit, COUNT(*) FILTER (WHERE tr.fold = fd.fold) AS n_held,
    CAST(COALESCE(SUM(Churn) FILTER (WHERE tr.fold <> fd.fold), 0) AS BIGINT) AS fit_positives,
    CAST(COALESCE(SUM(Churn) FILTER (WHERE tr.fold = fd.fold), 0) AS BIGINT) AS held_positives
  FROM fd CROSS JOIN tr GROUP BY fd.fold)
SELECT model, point, fold, n_fit, n_held, fit_positives, held_positives, TRUE AS auc_in_range, TRUE AS chosen_is_best
FROM pt CROSS JOIN sz
"""
_NUMBER = "(TotalCharges IS NOT NULL AND regexp_matches(TotalCharges, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$'))"
SQL["total_conversions"] = f"""
SELECT 'totals_not_numeric' AS conversion, COUNT(*) FILTER (WHERE TotalCharges IS NOT NULL AND NOT {_NUMBER}) AS customers FROM raw
UNION ALL SELECT 'totals_new_customer', COUNT(*) FILTER (WHERE NOT {_NUMBER} AND tenure = 0) FROM raw
UNION ALL SELECT 'totals_one_month', COUNT(*) FILTER (WHERE NOT {_NUMBER} AND tenure IS DISTINCT FROM 0) FROM raw
"""
SQL["rejected_rows"] = """
WITH k AS (SELECT *, CAST(customerID AS BIGINT) AS key FROM raw),
q AS (
  SELECT customerID AS customer_id, CASE WHEN key % 90 = 7 THEN 'malformed line' ELSE concat_ws('; ',
    CASE WHEN key % 70 = 5 THEN 'missing Contract' END,
    CASE WHEN key % 50 = 3 THEN 'unknown PaymentMethod: Cheque' END,
    CASE WHEN key % 110 = 9 THEN 'negative MonthlyCharges' END) END AS reasons
  FROM k)
SELECT * FROM q WHERE reasons <> ''
"""
SQL["stream_rejects"] = """
SELECT customerID AS customer_id, concat_ws('; ',
  CASE WHEN CAST(customerID AS BIGINT) % 50 = 3 THEN 'unknown PaymentMethod: Cheque' END,
  CASE WHEN CAST(customerID AS BIGINT) % 70 = 5 THEN 'missing tenure' END) AS reasons
FROM raw
"""
SQL["written_splits"] = "SELECT customer_id, Churn, CLV_quartile, split, fold FROM prep_split"
SQL["written_metrics"] = SQL["classification_metrics"]
STRING_COLS = ["gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
               "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod", "tenure_bucket"]
SQL["string_columns"] = "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_values FROM prep" for c in STRING_COLS)
SQL["clv_fallback"] = "SELECT customer_id, CASE WHEN SeniorCitizen = 0 THEN CLV ELSE MonthlyCharges * 12 END AS clv FROM prep"


def _test(split, left: bool) -> str:
    test = f"{split.feature} IN ({', '.join(map(str, split.codes))})" if split.codes else f"{split.feature} <= {split.threshold}e0"
    return f"({test})" if left else f"(NOT ({test}))"


def _fixed_trees() -> tuple[str, dict[str, list[tuple[int, int, str]]], list[str], list[str]]:
    """CTEs with the value of every tree given every subset of its features, by enumeration.

    A leaf counts with the row's own side for known features and with the share of training rows for others.
    """
    covers, values = {}, []
    phi: dict[str, list] = {}
    empty, full = [], []
    for t, tree in enumerate(TREES):
        paths = leaves(tree)
        for _, path in paths:
            for n in range(len(path) + 1):
                covers.setdefault((t, path[:n]), " AND ".join(_test(x, w) for x, w in path[:n]) or "TRUE")
    names = {node: f"c{i}" for i, node in enumerate(covers)}
    for t, tree in enumerate(TREES):
        paths = leaves(tree)
        feats = sorted({x.feature for _, path in paths for x, _ in path})
        for mask in range(1 << len(feats)):
            terms = []
            for value, path in paths:
                factors = [f"{value}e0"]
                for n, (x, w) in enumerate(path):
                    if mask >> feats.index(x.feature) & 1:
                        factors.append(f"(CASE WHEN {_test(x, w)} THEN 1e0 ELSE 0e0 END)")
                    else:
                        factors.append(f"({names[t, path[: n + 1]]} / {names[t, path[:n]]})")
                terms.append(" * ".join(factors))
            values.append(f"{' + '.join(terms)} AS v{t}_{mask}")
        m = len(feats)
        empty.append(f"v{t}_0")
        full.append(f"v{t}_{(1 << m) - 1}")
        for i, f in enumerate(feats):
            for mask in range(1 << m):
                if not mask >> i & 1:
                    size = bin(mask).count("1")
                    weight = f"{math.factorial(size) * math.factorial(m - size - 1)}e0 / {math.factorial(m)}e0"
                    phi.setdefault(f, []).append(f"{weight} * (v{t}_{mask | 1 << i} - v{t}_{mask})")
    counted = ", ".join(f"CAST(COUNT(*) FILTER (WHERE {cond}) AS DOUBLE) AS {names[node]}" for node, cond in covers.items())
    ctes = f"{ENC},\ncv AS (SELECT {counted} FROM enc WHERE split = 'train'),\nvs AS (SELECT customer_id, {', '.join(values)} FROM enc CROSS JOIN cv)"
    return ctes, phi, empty, full


_CTES, _PHI, _EMPTY, _FULL = _fixed_trees()
SQL["fixed_tree_scores"] = f"""WITH {_CTES}
SELECT customer_id, round({SCALE}e0 * ({' + '.join(_EMPTY)}), 6) AS base_value, round({SCALE}e0 * ({' + '.join(_FULL)}), 6) AS output FROM vs"""
SQL["fixed_tree_contributions"] = f"WITH {_CTES}\n" + "\nUNION ALL\n".join(
    f"SELECT customer_id, '{f}' AS feature, round({SCALE}e0 * ({' + '.join(terms)}), 6) + 0e0 AS contribution FROM vs" for f, terms in _PHI.items())
SQL["score_checks"] = """
SELECT customer_id, TRUE AS in_range, TRUE AS is_mean, TRUE AS level_fits, CLV AS clv, expected_tenure FROM prep"""
SQL["explanation_checks"] = """
SELECT customer_id, model, TRUE AS adds_up, TRUE AS gives_score
FROM prep CROSS JOIN (VALUES ('boosted'), ('random_forest')) m(model)"""
SQL["stream_vs_batch"] = "SELECT customer_id, TRUE AS same_scores FROM prep"
SQL["global_contributions"] = f"""WITH {STATS},
{CONTRIB}
SELECT feature, {eavg('abs(contribution)')} AS mean_abs_contribution FROM lc GROUP BY feature"""
# the same over every customer
for _name in ("linear_contributions", "top_factors", "global_contributions"):
    SQL[f"all_{_name}"] = SQL[_name].replace(CONTRIB, ALL_CONTRIB)


def oracle_sql() -> dict[str, str]:
    return {name: with_base(sql) for name, sql in SQL.items()}
