"""Canonical inputs from the star-schema test tables.

Each mapping is one SQL text that both Spark and a checking engine run, so operator and
check see the same rows. Names in braces are the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROFILES = """
SELECT
  CASE WHEN c_custkey % 10 = 3 THEN concat(' ', cast(c_custkey AS string), ' ')
       ELSE cast(c_custkey AS string) END AS customerID,
  CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  cast(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS int) AS SeniorCitizen,
  CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
  CASE WHEN c_nationkey % 3 = 0 THEN 'Yes' WHEN c_nationkey % 11 = 1 THEN NULL ELSE 'No' END AS Dependents,
  cast(c_custkey % 72 + 1 AS int) AS tenure,
  CASE WHEN c_custkey % 8 = 0 THEN 'No' ELSE 'Yes' END AS PhoneService,
  CASE WHEN c_custkey % 8 = 0 THEN 'No phone service' WHEN c_custkey % 5 < 2 THEN 'Yes' ELSE 'No' END AS MultipleLines,
  CASE WHEN c_custkey % 3 = 0 THEN 'DSL' WHEN c_custkey % 3 = 1 THEN 'Fiber optic' ELSE 'No' END AS InternetService,
  CASE WHEN c_custkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 4 = 1 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
  CASE WHEN c_custkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 5 = 1 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
  CASE WHEN c_custkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 7 = 1 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
  CASE WHEN c_custkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 11 = 1 THEN 'Yes' ELSE 'No' END AS TechSupport,
  CASE WHEN c_custkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 13 < 6 THEN 'Yes' ELSE 'No' END AS StreamingTV,
  CASE WHEN c_custkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 17 < 8 THEN 'Yes' ELSE 'unknown' END AS StreamingMovies,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'One year' WHEN 'MACHINERY' THEN 'Two year' ELSE 'Month-to-month' END AS Contract,
  CASE WHEN c_custkey % 9 < 4 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
  CASE c_custkey % 5 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
       WHEN 2 THEN 'Bank transfer (automatic)' WHEN 3 THEN 'Credit card (automatic)' ELSE 'Bank transfer' END AS PaymentMethod,
  abs(c_acctbal) / 1e2 AS MonthlyCharges,
  CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE cast(cast(floor(abs(c_acctbal)) AS bigint) AS string) END AS TotalCharges,
  CASE WHEN c_custkey % 4 = 0 THEN 'Yes' ELSE 'No' END AS Churn
FROM {customer}
"""

# amounts have two decimals and stay exact; orders are recharges, line items are data sessions of the ordering customer
EVENT_LOG = """
SELECT cast(o_custkey AS string) AS customer_id,
  cast(o_orderdate AS date) AS event_date,
  'RECHARGE' AS event_type,
  cast(o_totalprice AS decimal(18, 2)) AS recharge_amount,
  cast(NULL AS decimal(18, 2)) AS data_mb_used,
  cast(NULL AS double) AS call_duration_minutes,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'APP' WHEN '2-HIGH' THEN 'WEB' WHEN '3-MEDIUM' THEN 'AGENT' ELSE 'USSD' END AS channel,
  CASE o_orderstatus WHEN 'F' THEN 'DATA_BUNDLE_1GB' WHEN 'P' THEN 'VOICE_TOPUP_100' END AS offer_presented,
  cast(CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'True' ELSE 'False' END AS string) AS offer_accepted
FROM {orders}
UNION ALL
SELECT cast(o_custkey AS string), cast(l_shipdate AS date), 'DATA_SESSION',
  cast(NULL AS decimal(18, 2)), cast(l_quantity AS decimal(18, 2)), cast(NULL AS double),
  CASE l_returnflag WHEN 'R' THEN 'APP' WHEN 'A' THEN 'WEB' ELSE 'USSD' END,
  cast(NULL AS string), 'False'
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

CLICK_LOG = """
SELECT cast(user_id AS string) AS customer_id,
  cast(ts AS date) AS event_date,
  CASE event_type WHEN 'purchase' THEN 'RECHARGE' WHEN 'view' THEN 'DATA_SESSION' WHEN 'click' THEN 'CALL'
       WHEN 'signup' THEN 'SMS' ELSE 'OTHER' END AS event_type,
  CASE WHEN event_type = 'purchase' THEN value END AS recharge_amount,
  CASE WHEN event_type = 'view' THEN value END AS data_mb_used,
  CASE WHEN event_type = 'click' THEN value END AS call_duration_minutes,
  CASE event_id % 4 WHEN 0 THEN 'USSD' WHEN 1 THEN 'APP' WHEN 2 THEN 'AGENT' ELSE 'WEB' END AS channel,
  CASE WHEN event_id % 3 = 0 THEN 'DATA_BUNDLE_1GB' WHEN event_id % 7 = 0 THEN 'None' WHEN event_id % 11 = 0 THEN '' END AS offer_presented,
  CASE WHEN event_id % 6 = 0 THEN 'True' WHEN event_id % 12 = 3 THEN '1' ELSE 'False' END AS offer_accepted
FROM {events}
"""

# closed-form scores that stand in for fitted models
SCORES = """
SELECT cast(c_custkey AS string) AS customer_id,
  (c_custkey * 37 % 101) / 1e2 AS churn_risk_score,
  (c_custkey * 53 % 97) / 9.6e1 AS propensity_bundle,
  (c_custkey * 29 % 89) / 8.8e1 AS propensity_topup,
  (c_custkey * 71 % 83) / 8.2e1 AS propensity_reactivation,
  (c_custkey * 17 % 211) * 5e1 AS clv_90d,
  CASE WHEN c_custkey * 17 % 211 > 189 THEN 'Platinum' WHEN c_custkey * 17 % 211 > 158 THEN 'Gold'
       WHEN c_custkey * 17 % 211 > 105 THEN 'Silver' ELSE 'Bronze' END AS clv_tier,
  cast(c_custkey % 6 AS int) AS cluster
FROM {customer}
"""

SUPPRESSION = """
SELECT cast(c_custkey AS string) AS customer_id FROM {customer} WHERE c_custkey % 10 = 7
"""

# text columns with unreadable values, as a raw file would have
RAW_TEXT = """
SELECT cast(o_orderkey AS string) AS row_id,
  CASE WHEN o_orderkey % 97 = 0 THEN 'not a date' ELSE cast(cast(o_orderdate AS date) AS string) END AS event_date,
  CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' WHEN o_orderkey % 83 = 0 THEN '' ELSE cast(o_totalprice AS string) END AS amount
FROM {orders}
"""

TABLES = ["customer", "orders", "lineitem", "events"]


def sql_text(text: str) -> str:
    """The mapping for an engine that has the tables registered under their names."""
    return text.format(**{t: t for t in TABLES})


def _sources(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}


def adapt(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a mapping over the Parquet tables of a folder."""
    return spark.sql(text, **_sources(spark, sf_dir, text))


def source_rows(spark: SparkSession, sf_dir: str, text: str) -> int:
    """Rows of the tables a mapping reads, from their file footers."""
    return sum(table.count() for table in _sources(spark, sf_dir, text).values())
