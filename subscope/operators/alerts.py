"""Alert rules over drift reports and model metrics."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K

ALERT_SCHEMA = (
    "alert_id string, alert_type string, severity string, feature_name string, "
    "metric_value double, threshold double, message string, recommended_action string, "
    "timestamp string"
)


def _record(
    rows: DataFrame, kind: str, critical: Column, subject: Column, value: Column,
    threshold: float, message: Column, action: Column, timestamp: str | None,
) -> DataFrame:
    stamp = F.lit(timestamp or datetime.now().isoformat())
    return rows.select(
        F.md5(F.concat_ws("|", F.lit(kind), subject, stamp)).alias("alert_id"),
        F.lit(kind).alias("alert_type"),
        F.when(critical, "CRITICAL").otherwise("WARNING").alias("severity"),
        subject.alias("feature_name"),
        value.alias("metric_value"),
        F.lit(threshold).alias("threshold"),
        message.alias("message"),
        action.alias("recommended_action"),
        stamp.alias("timestamp"),
    )


def _raised(report: DataFrame) -> DataFrame:
    return report.where(F.col("drift_detected") | (F.col("psi") > K.PSI_WATCH))


def feature_alerts(report: DataFrame, timestamp: str | None = None) -> DataFrame:
    """An alert for each drifted or watched feature."""
    severe = F.col("psi") >= K.PSI_THRESHOLD
    return _record(
        _raised(report), "DATA_DRIFT", severe, F.col("feature_name"), F.col("psi"), K.PSI_THRESHOLD,
        F.format_string(
            K.ALERT_MESSAGES["feature"], "feature_name", "psi", "ks_p_value"
        ),
        F.when(severe, K.ALERT_ACTIONS["retrain"]).otherwise(K.ALERT_ACTIONS["watch"]),
        timestamp,
    )


def prediction_alerts(
    report: DataFrame, timestamp: str | None = None, score: str = "churn_risk_score"
) -> DataFrame:
    return _record(
        _raised(report), "PREDICTION_DRIFT", F.col("psi") >= K.PSI_THRESHOLD, F.lit(score), F.col("psi"),
        K.PSI_THRESHOLD,
        F.format_string(
            K.ALERT_MESSAGES["prediction"], "psi", "ks_p_value"
        ),
        F.lit(K.ALERT_ACTIONS["prediction"]),
        timestamp,
    )


def performance_alerts(metrics: DataFrame, timestamp: str | None = None) -> DataFrame:
    """Alerts for rows of (model_name, reference_auc, current_auc) whose AUC fell."""
    drop = F.col("reference_auc") - F.col("current_auc")
    return _record(
        metrics.where(drop >= K.AUC_DROP_WARNING), "PERFORMANCE_DROP", drop >= K.AUC_DROP_CRITICAL,
        F.col("model_name"), drop, K.AUC_DROP_CRITICAL,
        F.format_string(
            K.ALERT_MESSAGES["performance"],
            "model_name", "current_auc", "reference_auc", drop * 100.0,
        ),
        F.lit(K.ALERT_ACTIONS["performance"]),
        timestamp,
    )


def all_alerts(*alerts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, alerts)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Alerts per severity and per type, zeros kept, with the latest timestamp of all."""
    shown = [("severity", v) for v in K.ALERT_SEVERITIES] + [("type", v) for v in K.ALERT_TYPES]
    spec = alerts.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(g).alias("grouping"), F.lit(v).alias("name")) for g, v in shown]))
    )
    counted = (
        alerts.select(
            "timestamp",
            F.inline(
                F.array(
                    F.struct(F.lit("severity").alias("grouping"), F.col("severity").alias("name")),
                    F.struct(F.lit("type").alias("grouping"), F.col("alert_type").alias("name")),
                )
            ),
        )
        .groupBy("grouping", "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    latest = alerts.agg(F.max("timestamp")).scalar()
    return spec.join(counted, ["grouping", "name"], "full").select(
        "grouping", "name", F.coalesce("n", F.lit(0)).alias("alerts"), latest.alias("latest_timestamp")
    )
