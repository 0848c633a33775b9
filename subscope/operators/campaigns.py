"""Campaign target lists.

One description per campaign (who is eligible, how they are scored and ranked, what they
are offered) serves both the ranked lists and the eligibility summary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.functions.rules import lookup, recommend_channel, response_rate
from subscope.operators.ordering import Picked, global_rank, interpolate, pair_ranks, quantiles, select_long
from subscope.operators.profiles import suppress
from subscope.session import materialize

RECORD_SCHEMA = (
    "customer_id string, campaign_name string, segment_label string, rfm_segment string, "
    "churn_risk_score double, propensity_score double, clv_tier string, recommended_offer string, "
    "recommended_channel string, priority_score double, estimated_response_rate double, "
    "retention_budget string"
)


def _down(order_col: str) -> Column:
    """Sort key of a column descending: NaN is the largest value, nulls come last."""
    v = F.col(order_col).cast("double")
    group = F.when(v.isNull(), 2).when(F.isnan(v), 0).otherwise(1)
    return F.struct(group.alias("g"), F.when(group == 1, -v).otherwise(0.0).alias("v"))


def _upto(down: Column, tie: str, key: tuple) -> Column:
    """Whether a row comes no later than a (sort key, id)."""
    last, at = key
    edge = F.struct(F.lit(last.g).alias("g"), F.lit(last.v).alias("v"))
    return (down < edge) | ((down == edge) & (F.col(tie) <= F.lit(at)))


def top_n(df: DataFrame, order_col: str, n: int, tie: str = "customer_id") -> DataFrame:
    """The first n rows by a column descending, ties in id order; NaN is the largest value, nulls come last.

    The key at rank n is looked up by rank selection and the rows up to it are kept and range-sorted, so
    no task merges the best rows of all others, whatever n is. Only the keys are stored and read several times.
    """
    if n <= 0:
        return df.limit(0)
    down = _down(order_col)
    keys = materialize(df.select(F.lit("down").alias("_g"), down.alias("_v"), F.col(tie).alias("_id")), "keys")
    for key in select_long(keys, ["down"], lambda _, rows: [n] if n <= rows else [])["down"].keys:
        df = df.where(_upto(down, tie, key))
    return df.orderBy(down, tie)


def priority_rank(df: DataFrame, score: str, threshold: float = K.PROPENSITY_THRESHOLD) -> DataFrame:
    """1-based rank of targetable customers by score descending, -1 for the others."""
    flagged = df.withColumn("targetable", F.coalesce(F.col(score) >= threshold, F.lit(False)))
    keyed = flagged.where("targetable").withColumn("_neg", -F.col(score))
    ranked = global_rank(keyed, ["_neg", "customer_id"], "priority_rank").drop("_neg")
    rest = flagged.where("not targetable").withColumn("priority_rank", F.lit(-1).cast("bigint"))
    return ranked.unionByName(rest)


@dataclass(frozen=True)
class Campaign:
    """What distinguishes one target list from another.

    ``scale`` names a column divided by its maximum over the eligible customers; the quotient
    is passed to ``priority`` (and to ``score`` where the campaign has no model of its own).
    """

    eligible: Callable[[DataFrame], Column]
    score: Callable[[Column], Column]
    priority: Callable[[Column], Column]
    offer: Callable[[float | None], Column]
    scale: str | None = None
    channel: str | None = None
    median_of: str | None = None  # the offer depends on the median of this column over the list


def _tier_weight() -> Column:
    return lookup(F.col("clv_tier"), K.TIER_WEIGHT, 0.25)


def _low_risk(limit: float) -> Column:
    return F.col("churn_risk_score") < limit


def _with_spend(df: DataFrame) -> Column:
    p20 = quantiles(df, {"total_recharge_90d": [0.2]})["total_recharge_90d"][0.2]
    return F.col("total_recharge_90d") > F.lit(p20)


def _bundle_offer(median: float | None) -> Column:
    """By data use against the median of the list."""
    return F.when(F.col("_value") < F.lit(median), K.OFFERS["bundle_light"]).otherwise(K.OFFERS["bundle_heavy"])


def _is_top_tier() -> Column:
    return F.col("clv_tier").isin("Platinum", "Gold")


SPECS = {
    "churn_retention": Campaign(
        eligible=lambda df: F.col("churn_risk_score") >= K.CHURN_RISK_THRESHOLD,
        score=lambda _: F.col("churn_risk_score"),
        priority=lambda part: F.col("churn_risk_score") * 0.5 + _tier_weight() * 0.3 + part * 0.2,
        scale="tenure_months",
        offer=lambda *_: F.when(_is_top_tier(), K.OFFERS["retention_top"])
        .when(F.col("clv_tier") == "Silver", K.OFFERS["retention_silver"])
        .otherwise(K.OFFERS["retention_other"]),
    ),
    "bundle_upsell": Campaign(
        eligible=lambda df: (F.col("propensity_bundle") >= K.PROPENSITY_THRESHOLD) & _low_risk(0.5),
        score=lambda _: F.col("propensity_bundle"),
        priority=lambda _: F.col("propensity_bundle") * 0.7 + _tier_weight() * 0.3,
        offer=_bundle_offer,
        median_of="data_usage_mb_30d",
    ),
    "voice_topup": Campaign(
        eligible=lambda df: (F.col("propensity_topup") >= K.PROPENSITY_THRESHOLD) & _low_risk(0.5),
        score=lambda _: F.col("propensity_topup"),
        priority=lambda _: F.col("propensity_topup") * 0.7 + _tier_weight() * 0.3,
        offer=lambda *_: F.lit(K.OFFERS["voice"]),
    ),
    "reactivation": Campaign(
        eligible=lambda df: (F.col("days_since_last_recharge") > 20)
        & (F.col("propensity_reactivation") >= K.PROPENSITY_THRESHOLD)
        & _with_spend(df),
        score=lambda _: F.col("propensity_reactivation"),
        priority=lambda part: F.col("propensity_reactivation") * 0.6 + part * 0.4,
        scale="total_recharge_90d",
        offer=lambda *_: F.lit(K.OFFERS["reactivation"]),
        channel="USSD",
    ),
    "loyalty_reward": Campaign(
        eligible=lambda df: F.col("rfm_segment").isin("Champions", "Loyal Customers") & _low_risk(0.3),
        score=lambda part: part,
        priority=lambda part: part,
        scale="clv_90d",
        offer=lambda *_: F.when(_is_top_tier(), K.OFFERS["loyalty_top"]).otherwise(K.OFFERS["loyalty_other"]),
    ),
}


def _share(column: str, maximum: Column) -> Column:
    return F.col(column) / F.when(maximum > 0, maximum.cast("double")).otherwise(1.0)


def target_lists(
    master: DataFrame, kinds: Sequence[str], suppression: DataFrame | None = None, max_size: int = 5000
) -> DataFrame:
    """Ranked target lists of some campaigns, one after the other, in the 12-column record layout.

    All lists are one (list, key, customer) table: it is written once, and a single rank selection finds the last key
    of every list that is too long, and the median that an offer depends on. A list that is cut has another median than
    all who are eligible, and only then is that one selected by itself.
    """
    for kind in kinds:
        if kind not in SPECS:
            raise ValueError(f"unknown campaign: {kind}")
    base = suppress(master, suppression)
    ok = {k: SPECS[k].eligible(master) for k in kinds}
    scales = {k: SPECS[k].scale for k in kinds if SPECS[k].scale}
    top = base.agg(*[F.max(F.when(ok[k], F.col(c).cast("double"))).alias(k) for k, c in scales.items()]).first() if scales else {}
    cells = []
    for at, k in enumerate(kinds):
        spec = SPECS[k]
        part = _share(spec.scale, F.lit(top[k]).cast("double")) if spec.scale else F.lit(0.0)
        cell = F.struct(
            F.lit(at).alias("_list"),
            F.lit(k).alias("campaign_name"),
            spec.score(part).cast("double").alias("propensity_score"),
            spec.priority(part).cast("double").alias("priority_score"),
            (F.lit(None).cast("string") if spec.median_of else spec.offer(None)).alias("recommended_offer"),
            (F.lit(spec.channel) if spec.channel else recommend_channel(master)).alias("recommended_channel"),
            (F.col(spec.median_of).cast("double") if spec.median_of else F.lit(None).cast("double")).alias("_value"),
        )
        cells.append(F.when(ok[k], cell))
    has = set(master.columns)

    def label(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("Standard")) if name in has else F.lit("Standard")

    rows = base.select(
        "customer_id",
        label("ml_segment").alias("segment_label"),
        label("rfm_segment").alias("rfm_segment"),
        F.col("churn_risk_score").cast("double").alias("churn_risk_score"),
        "clv_tier",
        F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())),
    )
    rows = materialize(rows, "lists")
    down = _down("priority_score")
    sizes = {r.campaign_name: r["count"] for r in rows.groupBy("campaign_name").count().collect()}
    long = {k for k, n in sizes.items() if n > max_size}
    split = [k for k in kinds if SPECS[k].median_of]
    medians = F.struct(F.lit(1).alias("g"), F.col("_value").alias("v"))
    parts = [rows.where(F.col("campaign_name").isin(list(long))).select("campaign_name", down, "customer_id")] if long else []
    whole = [k for k in split if k in sizes and k not in long]
    if whole:
        held = rows.where(F.col("campaign_name").isin(whole) & F.col("_value").isNotNull())
        parts.append(held.select(F.concat(F.lit("median "), "campaign_name"), medians, "customer_id"))
    middle: dict[str, float | None] = dict.fromkeys(split)
    if parts and max_size > 0:
        keys = reduce(DataFrame.union, parts).toDF("_g", "_v", "_id")
        wanted = lambda g, n: pair_ranks(n, [0.5]) if g.startswith("median ") else [max_size]
        picked = select_long(keys, [*long, *(f"median {k}" for k in whole)], wanted, rows=sum(sizes.values()))
        for k in long:
            rows = rows.where((F.col("campaign_name") != k) | _upto(down, "customer_id", picked[k].keys[0]))
        for k in whole:
            found = picked[f"median {k}"]
            middle[k] = interpolate(Picked(found.rows, [(v.v, i) for v, i in found.keys]), [0.5])[0.5]
    for k in long & set(split) if max_size > 0 else ():
        middle[k] = quantiles(rows.where(F.col("campaign_name") == k), {"_value": [0.5]})["_value"][0.5]
    offer = F.col("recommended_offer")
    for k in split:
        offer = F.when(F.col("campaign_name") == k, SPECS[k].offer(middle[k])).otherwise(offer)
    rows = rows if max_size > 0 else rows.limit(0)
    return rows.orderBy("_list", down, "customer_id").select(
        "customer_id", "campaign_name", "segment_label", "rfm_segment", "churn_risk_score", "propensity_score", "clv_tier",
        offer.alias("recommended_offer"), "recommended_channel", "priority_score",
        response_rate(F.col("propensity_score")).alias("estimated_response_rate"),
        lookup(F.col("clv_tier"), K.TIER_BUDGET, "Minimal").alias("retention_budget"),
    )


def campaign(
    master: DataFrame, kind: str, suppression: DataFrame | None = None, max_size: int = 5000
) -> DataFrame:
    """Ranked target list of one campaign."""
    return target_lists(master, [kind], suppression, max_size)


def all_campaigns(
    master: DataFrame, suppression: DataFrame | None = None, max_size: int = 5000
) -> DataFrame:
    """All five lists in one result."""
    return target_lists(master, K.CAMPAIGNS, suppression, max_size)


def campaign_summary(master: DataFrame, suppression: DataFrame | None = None) -> DataFrame:
    """Eligible customers, mean propensity and mean tier index per campaign.

    No list is ranked: all five campaigns are counted in one pass over the customers. A mean
    of a scaled score is the mean of its column over its maximum.
    """
    base = suppress(master, suppression)
    index = lookup(F.col("clv_tier"), K.TIER_INDEX, None)
    sums = []
    for kind in K.CAMPAIGNS:
        spec = SPECS[kind]
        ok = spec.eligible(master)
        by_scale = kind == "loyalty_reward"
        score = F.col(spec.scale) if by_scale else spec.score(F.lit(0.0))
        mean = F.avg(F.when(ok, score))
        if by_scale:
            top = F.max(F.when(ok, F.col(spec.scale)))
            mean = mean / F.when(top > 0, top).otherwise(1.0)
        sums.append(
            F.struct(
                F.lit(kind).alias("campaign"),
                F.count_if(ok).alias("eligible_customers"),
                F.coalesce(mean, F.lit(0.0)).alias("avg_propensity_score"),
                F.coalesce(F.avg(F.when(ok, index)), F.lit(0.0)).alias("avg_clv_tier_index"),
            )
        )
    return base.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def channel_reach(opportunities: DataFrame) -> DataFrame:
    """Customers and mean propensity per campaign and channel."""
    return opportunities.groupBy("campaign_name", "recommended_channel").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("propensity_score").alias("avg_propensity")
    )
