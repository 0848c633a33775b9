"""Monitoring of a fitted model on planted shifts, and the windows it looks at."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subscope.models import churn, matrix
from subscope.plans import fixtures, monitoring
from subscope.sources import adapters as A

FEATURES = ["a", "b"]


def rows(spark, seed, shift=0.0, flip=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(900, 2)).round(3)
    y = (x[:, 0] + rng.normal(0, 0.3, 900) > 0.5).astype(int)
    pdf = pd.DataFrame(x + [shift, 0], columns=FEATURES).assign(customer_id=[f"c{i}" for i in range(900)], churn_label=1 - y if flip else y)
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def reference(spark):
    return rows(spark, 1)


@pytest.fixture(scope="module")
def model(reference):
    return churn.fit_churn(matrix.mark_split(reference, "churn_label"), FEATURES, trees=5, depth=3, step=0.3)


def test_unchanged_rows_raise_nothing(model, reference):
    run = monitoring.monitor(model, reference, reference, FEATURES)
    assert run.alerts.count() == 0
    quality = run.quality.first()
    assert quality.reference_auc == quality.current_auc > 0.85 and quality.model_name == "churn_model"
    held_out = {r.customer_id for r in matrix.mark_split(reference, "churn_label").where("is_test").collect()}
    assert {r.customer_id for r in run.reference.where("is_test").collect()} == held_out


def test_shifted_feature(spark, model, reference):
    """A shift of one input shows in its drift row, in the scores, and in no other input."""
    run = monitoring.monitor(model, reference, rows(spark, 2, shift=1.0), FEATURES, timestamp="2024-01-31T00:00:00")
    drifted = {r.feature_name: r.drift_detected for r in run.features.collect()}
    assert drifted == {"a": True, "b": False}
    assert run.predictions.first().drift_detected
    found = run.alerts.toPandas()
    assert {"DATA_DRIFT", "PREDICTION_DRIFT"} <= set(found.alert_type) and set(found[found.alert_type == "DATA_DRIFT"].feature_name) == {"a"}
    assert set(found.timestamp) == {"2024-01-31T00:00:00"} and found.alert_id.is_unique


def test_lost_quality(spark, model, reference):
    """The same inputs with turned labels: only the performance falls."""
    run = monitoring.monitor(model, reference, rows(spark, 1, flip=True), FEATURES)
    assert [r.alert_type for r in run.alerts.collect()] == ["PERFORMANCE_DROP"]
    assert run.quality.first().current_auc < 0.2


def test_one_class_and_missing_feature(model, reference):
    run = monitoring.monitor(model, reference, reference.withColumn("churn_label", F.lit(0)), FEATURES)
    assert run.quality.first().current_auc is None and run.alerts.count() == 0
    with pytest.raises(ValueError):
        monitoring.monitor(model, reference, reference.drop("b"), FEATURES)


def test_windows(spark, sf_dir):
    """The reference knows no event of the current window, whatever it holds, and both keep every customer."""
    raw, log = A.adapt(spark, sf_dir, A.PROFILES), fixtures.event_log(spark, sf_dir)
    last = log.agg(F.max("event_date")).first()[0]
    reference, current = monitoring.window_stores(raw, log, 365)
    assert reference.count() == current.count() == raw.count()
    late = F.col("event_date") >= F.date_sub(F.lit(last), 365)
    changed = log.withColumn("recharge_amount", F.when(late, F.col("recharge_amount") + 1).otherwise(F.col("recharge_amount")))
    again, other = monitoring.window_stores(raw, changed, 365)
    assert reference.exceptAll(again).count() == 0 and current.exceptAll(other).count() > 0


def test_windows_of_an_empty_log(spark, sf_dir):
    raw, log = A.adapt(spark, sf_dir, A.PROFILES), fixtures.event_log(spark, sf_dir).where("false")
    reference, current = monitoring.window_stores(raw, log, 365)
    assert reference.exceptAll(current).count() == 0 and reference.count() == raw.count()
    assert current.where("total_recharge_90d != 0").count() == 0
