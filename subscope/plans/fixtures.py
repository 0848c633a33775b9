"""Parameters shared by the registered queries and their SQL checks, and the stored master."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.operators import encoding, events
from subscope.plans.flows import feature_store, value_columns
from subscope.session import bucketed, materialize, small_tasks
from subscope.sources import adapters as A

STAMP = "2024-01-31T00:00:00"
QUERY_CUSTOMER = "77"
DIGITS = {"mae": 4, "rmse": 4, "std": 4}
# exact decimal sums and one division: both sides hold the same number, which is left as it is
UNROUNDED = ("recharge_trend", "data_usage_trend")
AMOUNT_COLUMNS = [
    "total_recharge_90d", "data_usage_mb_30d", "arpu", "recharge_count_30d",
    "days_since_last_recharge", "tenure_months",
]
ZCOLS = ["arpu", "data_usage_mb_30d", "days_since_last_recharge", "tenure_months", "engagement_score"]
# monitoring batches: every customer's features over two successive windows of the log, this many days each
WINDOW_DAYS = 365
BATCH_FEATURES = [c for c in K.EVENT_FEATURES if c not in ("customer_id", "preferred_channel")]
# closed-form scores of a batch, in text that both engines read
BATCH_SCORES = {
    "churn_risk_score": "least(1e0, days_since_last_recharge / 9e1) * 6e-1 + (1e0 - least(1e0, active_days_90d / 9e1)) * 4e-1",
    "propensity_bundle": "least(1e0, data_usage_mb_30d / 1e2)",
    "propensity_topup": "least(1e0, recharge_count_30d / 5e0)",
}
PERFORMANCE = {"churn_risk_score": "churn_model", "propensity_bundle": "bundle_model", "propensity_topup": "topup_model"}

_stored: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build, by: str | None = None) -> DataFrame:
    """Stores are tables: built from the given data once per application and folder, then scanned."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        table, rows = build(), A.source_rows(spark, sf_dir, A.EVENT_LOG)
        with small_tasks(spark, rows):
            _stored[key] = bucketed(table, name, by, rows) if by else materialize(table, name)
    return _stored[key]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole event log, scanned from the given tables."""
    return A.adapt(spark, sf_dir, A.EVENT_LOG)


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of the whole log, which the store and both monitoring windows are derived from.

    It lies in buckets of customers: a customer has few rows in it, however many in the log, and is summed up in place.
    """
    return _once(spark, sf_dir, "rollup", lambda: events.channel_rollup(event_log(spark, sf_dir)), "customer_id")


def batch(spark: SparkSession, sf_dir: str, earlier: bool) -> DataFrame:
    """Features, scores and label of the last window of the log, or of the one before it."""

    def build() -> DataFrame:
        log = rollup(spark, sf_dir)
        if earlier:
            last = events.reference_dates(log).select("max_date").scalar()
            log = log.where(F.col("event_date") < F.date_sub(last, WINDOW_DAYS))
        label = encoding.clean_profiles(A.adapt(spark, sf_dir, A.PROFILES)).select(F.col("customerID").alias("customer_id"), "churn_label")
        rows = events.event_features(log, None, long=WINDOW_DAYS).join(label, "customer_id")
        return rows.withColumns({name: F.expr(score) for name, score in BATCH_SCORES.items()})

    return _once(spark, sf_dir, "earlier" if earlier else "later", build)


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature store over the whole log."""
    return _once(
        spark, sf_dir, "store",
        lambda: feature_store(A.adapt(spark, sf_dir, A.PROFILES), rollup(spark, sf_dir)),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value store over the feature store, with closed-form scores."""
    return _once(
        spark, sf_dir, "master",
        lambda: value_columns(store(spark, sf_dir)).join(A.adapt(spark, sf_dir, A.SCORES), "customer_id"),
    )
