"""DuckDB oracle SQL for the registered queries.

Each query is written independently of the Spark code, in plain SQL over the
driver's tables, so that the two engines cross-check each other. The shared
building blocks are CTEs:

* ``raw``: the subscriber view over ``customer`` and ``orders`` (as given in
  FIXTURES.md section F6),
* ``clean``: typed rows, blanks imputed,
* ``feat``: engineered columns (training form),
* ``prep``: plus CLV quartile labels,
* ``split``: stratified 60/20/20 assignment by md5 order within class.
"""

from __future__ import annotations

RAW = """
WITH ref_dt AS (SELECT MAX(o_orderdate) AS mx FROM orders),
o AS (
  SELECT o_custkey, COUNT(*) AS n_orders,
         MIN(o_orderdate) AS first_dt, MAX(o_orderdate) AS last_dt
  FROM orders GROUP BY o_custkey),
b AS (
  SELECT c.c_custkey AS k, c.c_nationkey AS nk, c.c_mktsegment AS seg,
         COALESCE(o.n_orders, 0) AS n_orders,
         CASE WHEN o.last_dt IS NULL OR c.c_custkey % 50 = 0 THEN 0
              ELSE LEAST(72, (year(o.last_dt) - year(o.first_dt)) * 12
                             + (month(o.last_dt) - month(o.first_dt))) END AS tenure,
         18e0 + (c.c_acctbal + 1000e0) * 102e0 / 11000e0 AS mc,
         CASE WHEN o.last_dt IS NULL OR o.last_dt < ref_dt.mx - INTERVAL '365' DAY
              THEN 'Yes' ELSE 'No' END AS churn,
         CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'Fiber optic'
              WHEN c.c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'DSL'
              ELSE 'No' END AS net
  FROM customer c LEFT JOIN o ON o.o_custkey = c.c_custkey CROSS JOIN ref_dt)
SELECT CAST(k AS STRING) AS customerID,
  CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
  CASE WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
  CASE WHEN k % 5 < 2 THEN 'Yes' ELSE 'No' END AS Dependents,
  CAST(tenure AS INT) AS tenure,
  CASE WHEN k % 10 <> 0 THEN 'Yes' ELSE 'No' END AS PhoneService,
  CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN k % 7 < 3 THEN 'Yes' ELSE 'No' END AS MultipleLines,
  net AS InternetService,
  CASE WHEN net = 'No' THEN 'No internet service' WHEN k % 11 < 4 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
  CASE WHEN net = 'No' THEN 'No internet service' WHEN k % 13 < 5 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
  CASE WHEN net = 'No' THEN 'No internet service' WHEN k % 17 < 7 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
  CASE WHEN net = 'No' THEN 'No internet service' WHEN k % 19 < 7 THEN 'Yes' ELSE 'No' END AS TechSupport,
  CASE WHEN net = 'No' THEN 'No internet service' WHEN k % 23 < 11 THEN 'Yes' ELSE 'No' END AS StreamingTV,
  CASE WHEN net = 'No' THEN 'No internet service' WHEN k % 29 < 14 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
  CASE WHEN n_orders >= 13 THEN 'Two year' WHEN n_orders >= 11 THEN 'One year' ELSE 'Month-to-month' END AS Contract,
  CASE WHEN k % 31 < 18 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
  CASE nk % 4 WHEN 0 THEN 'Bank transfer (automatic)' WHEN 1 THEN 'Credit card (automatic)'
              WHEN 2 THEN 'Electronic check' ELSE 'Mailed check' END AS PaymentMethod,
  mc AS MonthlyCharges,
  CASE WHEN tenure = 0 OR k % 97 = 0 THEN ' '
       ELSE CAST(tenure * mc * (0.4e0 + (k % 13) * 0.1e0) AS STRING) END AS TotalCharges,
  churn AS Churn
FROM b
"""

NUMERIC_RE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

CLEAN = f"""
SELECT customerID AS customer_id, gender, SeniorCitizen, Partner, Dependents, tenure,
  PhoneService, MultipleLines, InternetService, OnlineSecurity, OnlineBackup,
  DeviceProtection, TechSupport, StreamingTV, StreamingMovies, Contract,
  PaperlessBilling, PaymentMethod, MonthlyCharges,
  COALESCE(CASE WHEN regexp_matches(TotalCharges, '{NUMERIC_RE}')
                THEN TRY_CAST(trim(TotalCharges) AS DOUBLE) END,
           CASE WHEN tenure = 0 THEN 0.0 ELSE MonthlyCharges END) AS TotalCharges,
  CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS Churn
FROM raw
"""

FEAT = """
SELECT c.*,
  CASE WHEN tenure <= 6 THEN '0-6m' WHEN tenure <= 12 THEN '6-12m'
       WHEN tenure <= 24 THEN '12-24m' ELSE '24m+' END AS tenure_bucket,
  (CASE WHEN PhoneService = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN MultipleLines = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN InternetService IN ('DSL', 'Fiber optic') THEN 1 ELSE 0 END)
  + (CASE WHEN OnlineSecurity = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN OnlineBackup = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN DeviceProtection = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN TechSupport = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN StreamingTV = 'Yes' THEN 1 ELSE 0 END)
  + (CASE WHEN StreamingMovies = 'Yes' THEN 1 ELSE 0 END) AS services_count,
  TotalCharges / (CASE WHEN tenure * MonthlyCharges = 0 THEN 1.0 ELSE tenure * MonthlyCharges END)
    AS monthly_to_total_ratio,
  CASE WHEN InternetService IN ('DSL', 'Fiber optic') AND TechSupport = 'No' THEN 1 ELSE 0 END
    AS flag_internet_no_tech_support,
  CASE WHEN InternetService = 'Fiber optic' AND MonthlyCharges > fc.fiber_cut THEN 1 ELSE 0 END
    AS flag_fiber_high_charges,
  CASE WHEN tenure <= 12 AND Contract = 'Month-to-month' THEN 1 ELSE 0 END
    AS flag_short_tenure_monthly,
  CASE WHEN Contract IN ('One year', 'Two year') THEN 24 ELSE 12 END AS expected_tenure,
  MonthlyCharges * (CASE WHEN Contract IN ('One year', 'Two year') THEN 24 ELSE 12 END) AS CLV
FROM clean c
CROSS JOIN (SELECT quantile_cont(MonthlyCharges, 0.75) AS fiber_cut FROM clean) fc
"""

CUTS = """
SELECT quantile_cont(CLV, 0.25) AS q1, quantile_cont(CLV, 0.5) AS q2,
       quantile_cont(CLV, 0.75) AS q3
FROM feat
"""

PREP = """
SELECT f.*,
  CASE WHEN CLV IS NULL THEN NULL WHEN CLV <= q.q1 THEN 'Low' WHEN CLV <= q.q2 THEN 'Medium'
       WHEN CLV <= q.q3 THEN 'High' ELSE 'Premium' END AS CLV_quartile
FROM feat f CROSS JOIN cuts q
"""

SPLIT = """
SELECT customer_id, Churn,
  CASE WHEN r < t THEN 'test' WHEN r < t + v THEN 'val' ELSE 'train' END AS split,
  CAST(CASE WHEN r >= t + v THEN (r - t - v) % 5 END AS INTEGER) AS fold
FROM (
  SELECT customer_id, Churn, r, t, (n - t + 3) // 4 AS v
  FROM (
    SELECT customer_id, Churn,
      row_number() OVER (PARTITION BY Churn ORDER BY md5('42:' || customer_id), customer_id) - 1 AS r,
      (count(*) OVER (PARTITION BY Churn) + 4) // 5 AS t,
      count(*) OVER (PARTITION BY Churn) AS n
    FROM clean) a) b
"""

PREP_SPLIT = """
SELECT p.*, s.split, s.fold FROM prep p JOIN split s USING (customer_id)
"""

BLOCKS = [("raw", RAW), ("clean", CLEAN), ("feat", FEAT), ("cuts", CUTS), ("prep", PREP),
          ("split", SPLIT), ("prep_split", PREP_SPLIT)]


def with_base(select_sql: str) -> str:
    """Prefix a SELECT with the shared CTEs."""
    ctes = ",\n".join(f"{name} AS ({body.strip()})" for name, body in BLOCKS)
    body = select_sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"
