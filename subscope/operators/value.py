"""RFM scores, spend tiers, behaviour flags, lifecycle stage and propensity labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.functions import rules
from subscope.operators.ordering import (
    Picked, bin_of, cut_ranks, interpolate, pair_ranks, quantiles, select_ranks,
)
from subscope.sources.contracts import require_columns

# order statistics that the value columns need: name -> (value, quantile bins, quantiles)
STATISTICS = {
    "recency": ("days_since_last_recharge", 5, []),
    "frequency": ("recharge_count_30d", 5, [0.5]),
    "monetary": ("total_recharge_30d", 5, []),
    "arpu": ("total_recharge_90d / 3", 4, [0.75]),
    "data": ("data_usage_mb_30d", 1, [0.75]),
}


@dataclass(frozen=True)
class Cutoffs:
    """Bin edges and quantiles of the customer base, found in one selection over all columns."""

    picked: dict[str, Picked]

    def bin(self, name: str, value: Column) -> Column:
        q = STATISTICS[name][1]
        return bin_of(self.picked[name].keys[: q - 1], value.cast("double"), F.col("customer_id"))

    def quantile(self, name: str, p: float) -> float | None:
        rows, keys = self.picked[name]
        _, q, ps = STATISTICS[name]
        return interpolate(Picked(rows, keys[q - 1 :]), ps)[p]


def cutoffs(df: DataFrame, names: Sequence[str] = tuple(STATISTICS)) -> Cutoffs:
    def ranks(name: str, n: int) -> list[int]:
        _, q, ps = STATISTICS[name]
        return cut_ranks(n, q) + pair_ranks(n, ps)

    values = {n: F.expr(STATISTICS[n][0]).cast("double") for n in names}
    return Cutoffs(select_ranks(df, values, ranks))


def rfm_scores(df: DataFrame, cut: Cutoffs | None = None) -> DataFrame:
    """Add r/f/m scores and the combined score; fewer days since recharge is a higher R."""
    require_columns(df, K.RFM_COLUMNS)
    cut = cut or cutoffs(df, ["recency", "frequency", "monetary"])
    return df.withColumns(
        {
            "r_score": F.lit(6) - cut.bin("recency", F.col("days_since_last_recharge")),
            "f_score": cut.bin("frequency", F.col("recharge_count_30d")),
            "m_score": cut.bin("monetary", F.col("total_recharge_30d")),
        }
    ).withColumn("rfm_score", F.expr("r_score * 100 + f_score * 10 + m_score"))


def with_rfm_segment(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "rfm_segment", rules.rfm_segment(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    )


def with_arpu(df: DataFrame) -> DataFrame:
    """Average monthly revenue of the three months the log stands for."""
    return df.withColumn("arpu", F.col("total_recharge_90d") / 3)


def arpu_tier(df: DataFrame, cut: Cutoffs | None = None) -> DataFrame:
    """Spend quartile by first-come rank; with fewer than four customers all are Bronze."""
    cut = cut or cutoffs(df, ["arpu"])
    if cut.picked["arpu"].rows < len(K.ARPU_TIERS):
        return df.withColumn("arpu_tier", F.lit(K.ARPU_TIERS[0]))
    quartile = cut.bin("arpu", F.col("arpu"))
    return df.withColumn(
        "arpu_tier", F.element_at(F.array(*[F.lit(t) for t in K.ARPU_TIERS]), quartile)
    )


def with_engagement(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "engagement_score",
        F.col("active_days_90d") / 90 * 0.4
        + F.col("app_usage_rate") * 0.3
        + F.col("offer_acceptance_rate") * 0.3,
    )


def with_churn_signals(df: DataFrame) -> DataFrame:
    flags = {
        "declining_recharge": F.col("recharge_trend") < -50,
        "long_silence": F.col("days_since_last_recharge") > 14,
        "low_activity": F.col("active_days_90d") < 20,
        "recharge_drop_flag": F.col("recharge_count_30d") < F.col("recharge_count_90d") / 6,
    }
    return df.withColumns({name: F.when(c, 1).otherwise(0) for name, c in flags.items()})


def with_upsell_signals(df: DataFrame, cut: Cutoffs | None = None) -> DataFrame:
    """Upsell flags; the two relative ones compare with quantiles of all customers."""
    cut = cut or cutoffs(df, ["data", "frequency"])
    flags = {
        "high_data_user": F.col("data_usage_mb_30d") > F.lit(cut.quantile("data", 0.75)),
        "frequent_recharger": F.col("recharge_count_30d") > F.lit(cut.quantile("frequency", 0.5)),
        "high_offer_responder": F.col("offer_acceptance_rate") > 0.20,
        "app_user": F.col("app_usage_rate") > 0.3,
        "premium_customer": F.col("arpu_tier").isin("Gold", "Platinum"),
    }
    return df.withColumns({name: F.when(c, 1).otherwise(0) for name, c in flags.items()})


def with_lifecycle(df: DataFrame, cut: Cutoffs | None = None) -> DataFrame:
    """Lifecycle stage; the first rule that holds wins, exactly 30 active days is no rule."""
    p75 = (cut or cutoffs(df, ["arpu"])).quantile("arpu", 0.75)
    tenure, silent, active = (
        F.col(c) for c in ("tenure_months", "days_since_last_recharge", "active_days_90d")
    )
    return df.withColumn(
        "lifecycle_stage",
        F.when((tenure >= 12) & (F.col("arpu") > F.lit(p75)), "High Value Loyal")
        .when((tenure >= 3) & (silent > 60), "Churned")
        .when((tenure >= 3) & (silent > 30), "Lapsing")
        .when((tenure < 3) & (active > 30), "New Active")
        .when((tenure < 3) & (active < 30), "New At-Risk")
        .otherwise("Active"),
    )


def with_behaviour(df: DataFrame, cut: Cutoffs | None = None) -> DataFrame:
    """Every behaviour column in dependency order."""
    cut = cut or cutoffs(df, ["arpu", "data", "frequency"])
    spend = with_churn_signals(with_engagement(arpu_tier(with_arpu(df), cut)))
    return with_lifecycle(with_upsell_signals(spend, cut), cut)


def propensity_labels(df: DataFrame) -> DataFrame:
    """Rule labels of the three offers."""
    cut = quantiles(df, {"recharge_count_30d": [0.5], "total_recharge_90d": [0.25]})
    labels = {
        "label_bundle_upgrade": (F.col("high_data_user") == 1)
        & (F.col("data_usage_trend") > 0)
        & (F.col("offer_acceptance_rate") > 0.15),
        "label_voice_topup": (F.col("recharge_count_30d") > F.lit(cut["recharge_count_30d"][0.5]))
        & (F.col("avg_recharge_amount") < 500)
        & (F.col("frequent_recharger") == 1),
        "label_reactivation": (F.col("days_since_last_recharge") > 20)
        & (F.col("total_recharge_90d") > F.lit(cut["total_recharge_90d"][0.25])),
    }
    return df.withColumns({name: F.when(c, 1).otherwise(0) for name, c in labels.items()})


def clv_thresholds(df: DataFrame, column: str = "total_recharge_90d") -> dict[float, float]:
    """The spend percentiles that separate the CLV tiers."""
    return quantiles(df, {column: [0.5, 0.75, 0.9]})[column]


def with_clv_tier(df: DataFrame, thresholds: dict[float, float], clv: str = "clv_90d") -> DataFrame:
    tier = rules.clv_tier(F.col(clv), *(thresholds[p] for p in (0.5, 0.75, 0.9)))
    return df.withColumn("clv_tier", tier).withColumns(
        {
            "retention_budget_tier": rules.lookup(F.col("clv_tier"), K.TIER_BUDGET, "Minimal"),
            "monthly_arpu_estimate": F.col(clv) / 3.0,
        }
    )


def clv_target(df: DataFrame) -> DataFrame:
    return df.withColumn("clv_log_target", rules.clv_target())
