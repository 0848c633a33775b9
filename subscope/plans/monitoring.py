"""Monitoring of a fitted churn model over two successive windows of the log: drift, held-out quality and alerts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.models.churn import churn_probability
from subscope.models.matrix import mark_split
from subscope.operators import alerts, events
from subscope.operators.drift import drift_report, prediction_drift
from subscope.operators.metrics import quality_each
from subscope.plans.flows import value_store
from subscope.session import materialize
from subscope.sources.contracts import require_columns

SCORE = "churn_risk_score"


class Run(NamedTuple):
    """What one monitoring run found; all but the last two are stored tables."""

    reference: DataFrame  # the model's inputs, score and split of each customer, per window
    current: DataFrame
    features: DataFrame  # a drift row per input of the model
    predictions: DataFrame  # one drift row, of the scores
    quality: DataFrame  # model_name, reference_auc, current_auc
    alerts: DataFrame


def window_stores(raw_profiles: DataFrame, log: DataFrame, days: int, short: int = 30) -> tuple[DataFrame, DataFrame]:
    """Reference and current value store: the last ``days`` days of the log, and as many that end before those.

    Each is what a rebuild of the store gives on the last day of its window: no later event counts, and cut points are
    those of the window. ``log`` is rolled up once; both stores are read from the rollup. A customer without events in
    a window has the defaults there; of a log shorter than the current window, all customers have them in the reference.
    """
    log = events.stored_rollup(log)
    last = events.reference_dates(log).select("max_date").scalar()
    before = log.where(F.col("event_date") < F.date_sub(last, days))
    return tuple(value_store(raw_profiles, part, short=short, long=days) for part in (before, log))


def monitor(
    model: PipelineModel, reference: DataFrame, current: DataFrame, features: Sequence[str], label: str = "churn_label",
    model_name: str = "churn_model", timestamp: str | None = None,
) -> Run:
    """Score both windows with ``model`` and compare its inputs, its scores and its AUC.

    Every window is scored once, as a narrow transform, and stored. The AUC of a window is that of the customers whom
    the split by id held out of the fit; without both classes among them it is null and raises nothing. A missing
    feature is an error.
    """
    sides = []
    for df in (reference, current):
        require_columns(df, features)
        rows = mark_split(df.select("customer_id", label, *features), label)
        sides.append(materialize(churn_probability(model, rows), "monitored"))
    ref, cur = sides
    found = materialize(drift_report(ref, cur, features), "feature-drift")
    scores = materialize(prediction_drift(ref, cur, SCORE), "prediction-drift")
    held_out = [
        df.where("is_test").select(F.lit(side).alias("model"), F.col(SCORE).alias("score"), F.col(label).alias("label"))
        for side, df in (("reference", ref), ("current", cur))
    ]
    aucs = quality_each(reduce(DataFrame.unionAll, held_out), dict.fromkeys(("reference", "current"), K.PROPENSITY_THRESHOLD))
    quality = aucs.agg(
        F.lit(model_name).alias("model_name"),
        *[F.max(F.when(F.col("model") == side, F.col("auc_roc"))).alias(f"{side}_auc") for side in ("reference", "current")],
    )
    quality = materialize(quality, "quality")
    raised = alerts.all_alerts(
        alerts.feature_alerts(found, timestamp), alerts.prediction_alerts(scores, timestamp), alerts.performance_alerts(quality, timestamp)
    )
    return Run(ref, cur, found, scores, quality, raised)
