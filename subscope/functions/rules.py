"""Business rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K


def lookup(key: Column, mapping: Mapping[str, object], default: object) -> Column:
    """Literal dictionary lookup with a default, as a CASE that stays in generated code."""
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def risk_tier(score: Column) -> Column:
    return (
        F.when(score > 0.8, "Critical")
        .when(score > 0.65, "High")
        .when(score > 0.4, "Medium")
        .otherwise("Low")
    )


def risk_action(score: Column) -> Column:
    return lookup(risk_tier(score), K.RISK_ACTIONS, K.RISK_ACTIONS["Low"])


def response_rate(score: Column) -> Column:
    return F.when(score > 0.8, 0.35).when(score > 0.65, 0.20).when(score > 0.5, 0.10).otherwise(0.03)


def recommend_channel(df: DataFrame) -> Column:
    """Contact channel of a customer from whichever preference columns ``df`` has."""
    has = set(df.columns)

    def num(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in has else F.lit(0)

    text = F.upper("preferred_channel") if "preferred_channel" in has else F.lit("")
    tier = F.col("clv_tier") if "clv_tier" in has else F.lit("Bronze")
    return (
        F.when((num("app_usage_rate") > 0.3) | (num("preferred_channel_app") == 1), "PUSH_NOTIFICATION")
        .when((text == "USSD") | (num("preferred_channel_ussd") == 1), "USSD")
        .when(tier.isin("Platinum", "Gold"), "OUTBOUND_CALL")
        .otherwise("SMS")
    )


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Segment of a customer from the three digits; the first rule that holds wins."""
    return (
        F.when((r >= 5) & (f >= 4) & (m >= 4), "Champions")
        .when(r == 1, "Lost Customers")
        .when((r == 5) & (f == 1), "New Customers")
        .when((f >= 3) & (m >= 3), F.when(r <= 2, "At Risk").otherwise("Loyal Customers"))
        .when((r >= 4) & (f <= 3), "Potential Loyalists")
        .otherwise("Hibernating")
    )


def clv_target() -> Column:
    return F.log1p(F.col("total_recharge_90d") * (1 - F.col("churn_label") * 0.8))


def clv_back_transform(log_value: Column) -> Column:
    return F.greatest(F.expm1(log_value), F.lit(0.0))


def clv_tier(clv: Column, p50: float, p75: float, p90: float) -> Column:
    return (
        F.when(clv > p90, "Platinum")
        .when(clv > p75, "Gold")
        .when(clv > p50, "Silver")
        .otherwise("Bronze")
    )
