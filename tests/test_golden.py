"""Hand-computed results of five customers and nine events."""

import pytest

from subscope.operators import events
from subscope.plans import flows

FEATURES = {
    # recharges, recharge sum, recency, data 30d, active days, channel, app rate, offers, taken, silence
    "1": (1, 500.0, 27, 350.5, 2, "APP", 0.5, 1, 1, 13),
    "2": (1, 1000.0, 23, 0.0, 2, "APP", 0.5, 0, 0, 8),
    "3": (1, 200.0, 18, 0.0, 2, "AGENT", 0.0, 0, 0, 6),
    "4": (1, 1500.0, 26, 1200.0, 2, "APP", 0.5, 1, 1, 0),
    "5": (1, 100.0, 25, 0.0, 1, "USSD", 0.0, 0, 0, 25),
}
COLUMNS = [
    "recharge_count_90d", "total_recharge_90d", "days_since_last_recharge", "data_usage_mb_30d",
    "active_days_90d", "preferred_channel", "app_usage_rate", "offers_presented",
    "offers_accepted", "days_since_last_activity",
]
VALUE = {
    "1": (1, 1, 3, "Lost Customers", 166.6667, "Silver", 0.458889, "Active"),
    "2": (4, 2, 4, "Potential Loyalists", 333.3333, "Gold", 0.158889, "Active"),
    "3": (5, 3, 2, "Potential Loyalists", 66.6667, "Bronze", 0.008889, "Active"),
    "4": (2, 4, 5, "At Risk", 500.0, "Platinum", 0.458889, "High Value Loyal"),
    "5": (3, 5, 1, "Hibernating", 33.3333, "Bronze", 0.004444, "New At-Risk"),
}
VALUE_COLUMNS = [
    "r_score", "f_score", "m_score", "rfm_segment", "arpu", "arpu_tier", "engagement_score", "lifecycle_stage",
]


def test_event_features(small):
    got = pytest.rows(events.event_features(small[1]), "customer_id")
    assert {k: tuple(v[c] for c in COLUMNS) for k, v in got.items()} == FEATURES
    assert all(v["recharge_trend"] == 0 and v["data_usage_trend"] == 0 for v in got.values())


def test_value_store(small):
    got = pytest.rows(flows.value_store(*small), "customer_id")
    for key, want in VALUE.items():
        for column, value in zip(VALUE_COLUMNS, want):
            if isinstance(value, float):
                assert got[key][column] == pytest.approx(value, abs=1e-4)
            else:
                assert got[key][column] == value, (key, column)


def test_store_encoding(small):
    got = pytest.rows(flows.feature_store(*small), "customer_id")
    assert got["1"]["contract_1yr"] == 1 and got["2"]["contract_monthly"] == 1 and got["4"]["internet_none"] == 1
    assert got["3"]["MultipleLines_No phone service"] == 1 and got["2"]["MultipleLines_Yes"] == 1
    assert got["2"]["SeniorCitizen"] == "Yes" and got["3"]["churn_label"] == 1
    assert "MultipleLines_No" not in got["1"] and "gender" not in got["1"]


def test_customers_without_events(small):
    profiles, log = small
    quiet = log.where("customer_id <> '5'")
    zero = pytest.rows(flows.feature_store(profiles, quiet), "customer_id")["5"]
    assert zero["days_since_last_recharge"] == 0
    assert sum(v for c, v in zero.items() if c.startswith("preferred_channel_")) == 0
    ninety = pytest.rows(flows.feature_store_ordinal(profiles, quiet), "customer_id")["5"]
    assert ninety["days_since_last_recharge"] == 90 and ninety["recharge_count_90d"] == 0


def test_windows(small):
    _, log = small
    recent = events.filter_events(log, "RECHARGE", days=25)
    assert sorted(r.customer_id for r in recent.collect()) == ["2", "3", "5"]
    fixed = events.filter_events(log, "RECHARGE", ref="2026-07-05", days=2)
    assert {r.customer_id for r in fixed.collect()} >= {"2", "5"}
