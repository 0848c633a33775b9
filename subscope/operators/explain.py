"""Ranking of per-customer contributions and naming of clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K


def _ordered(contributions: Mapping[str, Column]) -> Column:
    """Contributions as structs, largest absolute value first, equal ones by name."""
    cells = [
        F.struct((-F.abs(c)).alias("size"), F.lit(name).alias("feature"), c.alias("contribution"))
        for name, c in contributions.items()
    ]
    return F.sort_array(F.array(*cells))


def mean_contributions(found: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_name, mean_abs_contribution) over all rows of (…, contributions), for every model feature."""
    names = F.array(*[F.lit(f) for f in features])
    rows = found.select(F.posexplode("contributions").alias("at", "c"))
    return rows.groupBy(F.element_at(names, F.col("at") + 1).alias("feature_name")).agg(
        F.avg(F.abs("c")).alias("mean_abs_contribution")
    )


def top_factors(
    df: DataFrame, contributions: Mapping[str, Column], k: int = 5, id_col: str = "customer_id"
) -> DataFrame:
    """The k strongest features of every row with their direction; rows are sorted in place, no shuffle."""
    return df.select(
        id_col, F.posexplode(F.slice(_ordered(contributions), 1, k)).alias("position", "x")
    ).select(
        id_col,
        (F.col("position") + 1).alias("position"),
        F.col("x.feature").alias("feature"),
        F.col("x.contribution").alias("contribution"),
        F.when(F.col("x.contribution") > 0, "increasing").otherwise("decreasing").alias("direction"),
    )


def top_factor_names(contributions: Mapping[str, Column], k: int = 3) -> Column:
    """Array of the k strongest feature names."""
    return F.transform(F.slice(_ordered(contributions), 1, k), lambda x: x["feature"])


ROLES = [
    ("dormant", "days_since_last_recharge"),
    ("high_value", "arpu"),
    ("at_risk", "churn_risk_score"),
    ("loyal", "tenure_months"),
    ("price", "recharge_count_30d"),
]


def label_clusters(profiles: DataFrame) -> DataFrame:
    """Business label of every cluster of a profile table (one row per cluster).

    With six clusters each role takes, in turn, the remaining cluster with the largest
    value of its metric, and the last cluster is the rising one. Any other number of clusters is
    just numbered. The profile table has k rows, so it is handled as one array.
    """
    risk = "churn_risk_score" if "churn_risk_score" in profiles.columns else "days_since_last_recharge"
    roles = [(r, risk if r == "at_risk" else m) for r, m in ROLES]
    metrics = sorted({m for _, m in roles})
    step = profiles.agg(
        F.collect_list(F.struct("cluster", *[F.col(m).cast("double").alias(m) for m in metrics])).alias("free")
    ).withColumn("k", F.size("free"))
    for role, metric in roles:
        best = F.array_max(
            F.transform("free", lambda x: F.struct(x[metric].alias("v"), (-x["cluster"]).alias("c")))
        )
        step = step.withColumn(role, -best["c"]).withColumn(
            "free", F.filter("free", lambda x: x["cluster"] != F.col(role))
        )
    picks = [*[(r, F.col(r)) for r, _ in roles], ("rising", F.get("free", F.lit(0))["cluster"])]
    named = F.array(
        *[
            F.struct(c.alias("cluster"), *[F.lit(t).alias(n) for t, n in zip(K.SEGMENT_TEXTS[r], TEXT_COLUMNS)])
            for r, c in picks
        ]
    )
    six = step.where("k = 6").select(F.inline(named))
    size = profiles.agg(F.count(F.lit(1))).scalar()
    other = profiles.where(size != 6).select(
        "cluster",
        F.concat(F.lit("Segment "), F.col("cluster").cast("string")).alias("segment_label"),
        *[F.lit(t).alias(n) for t, n in zip(K.OTHER_SEGMENT_TEXT, TEXT_COLUMNS[1:])],
    )
    return six.unionByName(other)


TEXT_COLUMNS = ["segment_label", "description", "recommended_campaign"]
