"""The tables behind the dashboard charts and summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.functions.rules import risk_tier
from subscope.functions.stats import bin_index
from subscope.operators.campaigns import campaign_summary


def _rows(df: DataFrame, name: str, values: list) -> DataFrame:
    """A literal one-column frame that fixes which rows a report shows."""
    spark = df.sparkSession
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def segment_profiles(df: DataFrame) -> DataFrame:
    cols = ["days_since_last_recharge", "recharge_count_30d", "total_recharge_30d", "monthly_charges"]
    return df.groupBy("rfm_segment").agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def cluster_profiles(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Mean of the profile metrics and size of each cluster."""
    metrics = [c for c in K.CLUSTER_METRICS if c in df.columns]
    return df.groupBy(F.col(cluster_col).alias("cluster")).agg(
        *[F.avg(c).alias(c) for c in metrics], F.count(F.lit(1)).alias("count")
    )


def clv_tier_summary(df: DataFrame) -> DataFrame:
    """Size, mean CLV and share of every tier, absent tiers as zeros."""
    total = df.agg(F.count(F.lit(1))).scalar()
    found = df.groupBy("clv_tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg("clv_90d").alias("mean")
    )
    return (
        _rows(df, "clv_tier", K.TIERS)
        .join(found, "clv_tier", "left")
        .select(
            "clv_tier",
            F.coalesce("n", F.lit(0)).alias("customers"),
            F.coalesce("mean", F.lit(0.0)).alias("mean_clv"),
            F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)).alias("percent"),
        )
    )


def segment_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("segment")).agg(F.count(F.lit(1)).alias("customers"))


def lifecycle_funnel(df: DataFrame) -> DataFrame:
    """Charted stages in order with their counts, absent stages as zeros."""
    found = df.groupBy("lifecycle_stage").agg(F.count(F.lit(1)).alias("n"))
    stages = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(s) for s in K.FUNNEL_STAGES])).alias("position", "lifecycle_stage")
    )
    return stages.join(found, "lifecycle_stage", "left").select(
        "position", "lifecycle_stage", F.coalesce("n", F.lit(0)).alias("customers")
    )


def rfm_heatmap(df: DataFrame) -> DataFrame:
    """Mean monthly charges of the 25 R x F cells, empty cells as 0."""
    cells = _rows(df, "r_score", list(range(1, 6))).select(
        "r_score", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("f_score")
    )
    found = df.groupBy("r_score", "f_score").agg(F.avg("monthly_charges").alias("mean"))
    return cells.join(found, ["r_score", "f_score"], "left").select(
        "r_score", "f_score", F.coalesce("mean", F.lit(0.0)).alias("avg_monthly_charges")
    )


def histograms(df: DataFrame, bins: Mapping[str, int], name: str = "column") -> DataFrame:
    """Equal-width histograms of several columns between their smallest and largest values, empty bins as 0.

    Two passes whatever the number of columns: one aggregate finds all ranges, one counts the bins of all columns. A
    constant column is put in the middle of a range of width one; one without values has bins without bounds.
    """
    v = {c: F.col(c).cast("double") for c in bins}
    spans = df.agg(*[F.min(x).alias(f"lo_{i}") for i, x in enumerate(v.values())], *[F.max(x).alias(f"hi_{i}") for i, x in enumerate(v.values())]).first()
    cells, grid = [], []
    for i, (c, n) in enumerate(bins.items()):
        span = spans[f"lo_{i}"], spans[f"hi_{i}"]
        if span[0] is not None and span[0] == span[1]:
            span = span[0] - 0.5, span[1] + 0.5
        edges = ("cast(NULL AS double)" if x is None else f"cast('{x!r}' AS double)" for x in span)
        at = bin_index(f"cast(`{c}` AS double)", *edges, n)
        cells.append(F.when(v[c].isNotNull(), F.struct(F.lit(c).alias(name), at.alias("bin"))))
        lo, hi = (F.lit(x).cast("double") for x in span)
        grid += [F.struct(F.lit(c).alias(name), F.lit(k).alias("bin"), (lo + F.lit(k) * (hi - lo) / n).alias("bin_start")) for k in range(n)]
    found = df.select(F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull()))).groupBy(name, "bin").agg(F.count(F.lit(1)).alias("n"))
    shown = df.sparkSession.range(1).select(F.inline(F.array(*grid)))
    return shown.join(found, [name, "bin"], "left").select(name, "bin", "bin_start", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """The histogram of one column."""
    return histograms(df, {column: bins}).drop("column")


def kpi_summary(master: DataFrame, suppression: DataFrame | None = None) -> DataFrame:
    """Headline numbers; a customer on two lists counts twice as campaign-eligible."""
    eligible = campaign_summary(master, suppression).agg(F.sum("eligible_customers")).scalar()
    n = F.count(F.lit(1))
    at_risk: Column = F.count_if(F.col("churn_risk_score") >= K.CHURN_RISK_THRESHOLD)
    return master.agg(
        n.alias("total_customers"),
        at_risk.alias("at_risk_customers"),
        F.coalesce(F.avg("arpu"), F.lit(0.0)).alias("avg_arpu"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("clv_tier") == "Platinum") * 100.0, n), F.lit(0.0)
        ).alias("platinum_percent"),
    ).withColumn("campaign_eligible", eligible)


def score_summary(scored: DataFrame, segment: str = "ml_segment") -> DataFrame:
    """(section, name, customers, mean) of scored customers: all, critical and high churn risk, segments, value tiers, offers.

    Only an offer has a mean, that of its propensity, over the customers with one. Tiers and offers nobody has are listed
    with zero customers, segments are those that occur. One pass, whatever the number of sections.
    """
    none = F.lit(None).cast("double")
    offers = [score for score in ("propensity_bundle", "propensity_topup", "propensity_reactivation") if score in scored.columns]
    shown = [("all", "customers"), ("churn_risk", "Critical"), ("churn_risk", "High")]
    shown += [("clv_tier", t) for t in K.TIERS] + [("propensity", o) for o in offers]

    def cell(section: str, name: Column, score: Column = none) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("name"), score.alias("score"))

    cells = [cell("all", F.lit("customers")), cell("segment", F.col(segment)), cell("clv_tier", F.col("clv_tier"))]
    cells.append(F.when(F.col("churn_risk_score") > 0.65, cell("churn_risk", risk_tier(F.col("churn_risk_score")))))
    cells += [F.when(F.col(o).isNotNull(), cell("propensity", F.lit(o), F.col(o).cast("double"))) for o in offers]
    found = scored.select(F.inline(F.array_compact(F.array(*cells)))).where("name is not null").groupBy("section", "name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")
    )
    fixed = scored.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("name")) for a, b in shown])))
    return fixed.join(found, ["section", "name"], "full").select("section", "name", F.coalesce("n", F.lit(0)).alias("customers"), "mean")
