"""Every registered query against its SQL check."""

import pandas as pd
import pytest

import __spark_entry__ as entry_module
from subscope.plans import catalog, checks

QUERIES, CHECKS = catalog.QUERIES, checks.build()
NO_CHECK = {
    "churn_model_scores", "churn_attribution", "model_roundtrip", "kmeans_segments", "k_selection",
    "churn_attribution_summary", "churn_explanation", "model_evaluation", "propensity_scores", "clv_scores", "cv_r2", "score_all_models",
    "model_prediction_drift", "model_performance", "model_alerts",
}


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_every_query_is_covered():
    assert set(QUERIES) <= set(entry_module.queries()) and set(CHECKS) <= set(entry_module.oracle_sql())
    assert set(QUERIES) - set(CHECKS) == NO_CHECK
    assert not set(CHECKS) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(name, spark, sf_dir, duck):
    got = normal(QUERIES[name](spark, sf_dir).toPandas())
    want = normal(duck.execute(CHECKS[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 150 and "lifecycle_stage" in df.columns
