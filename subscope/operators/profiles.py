"""Joins of profiles with features, lookups and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.functions import rules


def join_features(profiles: DataFrame, features: DataFrame) -> DataFrame:
    """Profile LEFT JOIN features; the strategy is left to statistics and AQE."""
    return profiles.join(features, "customer_id", "left")


def customers_without_events(profiles: DataFrame, events: DataFrame) -> DataFrame:
    return profiles.join(events.select("customer_id").distinct(), "customer_id", "left_anti")


def key_integrity(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """Ids found on one side only, tagged with the side."""
    p = profiles.select("customer_id").distinct()
    e = events.select("customer_id").distinct()
    no_events = p.join(e, "customer_id", "left_anti").withColumn("only_in", F.lit("profiles"))
    no_profile = e.join(p, "customer_id", "left_anti").withColumn("only_in", F.lit("events"))
    return no_events.unionByName(no_profile)


def suppress(df: DataFrame, suppression: DataFrame | None) -> DataFrame:
    """Drop customers on a caller-supplied list.

    No broadcast hint: the planner broadcasts the list only if its size allows.
    """
    if suppression is None:
        return df
    return df.join(suppression.select("customer_id"), "customer_id", "left_anti")


def lookup(df: DataFrame, column: str, mapping: Mapping[str, object], default: object, out: str) -> DataFrame:
    return df.withColumn(out, rules.lookup(F.col(column), mapping, default))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def customer_profile(master: DataFrame, customer_id: str, threshold: float = 0.5) -> DataFrame:
    """All scores of one customer with defaults; an unknown id gives no row."""
    has = set(master.columns)

    def get(name: str, default: object) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in has else F.lit(default)

    score = get("churn_risk_score", 0.0)
    return master.where(F.col("customer_id") == customer_id).select(
        "customer_id",
        get("tenure_months", 0).cast("int").alias("tenure_months"),
        score.alias("churn_risk_score"),
        (score >= threshold).alias("churn_predicted"),
        rules.risk_tier(score).alias("risk_tier"),
        get("clv_90d", 0.0).alias("clv_90d"),
        get("clv_tier", "Bronze").alias("clv_tier"),
        get("rfm_segment", "Lost").alias("rfm_segment"),
        get("ml_segment", "Dormant").alias("ml_segment"),
        *[
            get(c, 0.0).alias(c)
            for c in ("propensity_bundle", "propensity_topup", "propensity_reactivation")
        ],
        get("lifecycle_stage", "Active").alias("lifecycle_stage"),
    )


def at_risk(
    master: DataFrame, min_score: float = K.CHURN_RISK_THRESHOLD, tier: str | None = None, limit: int = 100
) -> DataFrame:
    """The ``limit`` customers with the highest risk at or above ``min_score``."""
    rows = master.where(F.col("churn_risk_score") >= min_score)
    if tier is not None:
        rows = rows.where(F.col("clv_tier") == tier)
    wanted = [
        "customer_id", "tenure_months", "monthly_charges", "total_charges", "churn_risk_score",
        "clv_90d", "clv_tier", "rfm_segment", "ml_segment",
    ]
    return (
        rows.orderBy(F.desc("churn_risk_score"), "customer_id")
        .limit(limit)
        .select(*[c for c in wanted if c in master.columns])
    )
