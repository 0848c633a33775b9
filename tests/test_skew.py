"""A customer with a large share of the log gets the same results as in pandas."""

import numpy as np
import pandas as pd
import pytest

from subscope.operators import drift, events


@pytest.fixture(scope="module")
def log():
    rng = np.random.default_rng(5)
    n = 4000
    kind = rng.choice(["RECHARGE", "DATA_SESSION", "CALL"], n)
    who = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 40, n).astype(str))
    day = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60, n), unit="D")
    return pd.DataFrame(
        {
            "customer_id": who,
            "event_date": day.date,
            "event_type": kind,
            "recharge_amount": np.where(kind == "RECHARGE", rng.choice([100.0, 250.0, 500.0], n), np.nan),
            "data_mb_used": np.where(kind == "DATA_SESSION", rng.random(n).round(3) * 100, np.nan),
            "call_duration_minutes": np.nan,
            "channel": rng.choice(["APP", "USSD", "WEB", None], n),
            "offer_presented": rng.choice(["X", "", "None", None], n),
            "offer_accepted": rng.choice(["True", "1", "False", None], n),
        }
    )


def polyfit(x, y):
    return 0.0 if len(x) < 2 or len(set(x)) < 2 else float(np.polyfit(x, y, 1)[0])


def test_features_of_a_hot_customer(spark, log):
    df = spark.createDataFrame(log.astype(object).where(log.notna(), None), (
        "customer_id string, event_date date, event_type string, recharge_amount double, data_mb_used double, "
        "call_duration_minutes double, channel string, offer_presented string, offer_accepted string"))
    got = pytest.frame(events.event_features(df, short=10), "customer_id").set_index("customer_id")
    ordinal = pytest.frame(events.trend_ordinal(df), "customer_id").set_index("customer_id")
    last = log.event_date.max()
    for who, g in log.groupby("customer_id"):
        row = got.loc[who]
        r, s = g[g.event_type == "RECHARGE"], g[g.event_type == "DATA_SESSION"]
        days = [(d - last).days for d in r.event_date]
        assert row.recharge_count_90d == len(r)
        assert row.total_recharge_90d == pytest.approx(r.recharge_amount.sum())
        assert row.total_recharge_30d == pytest.approx(r[r.event_date.map(lambda d: (last - d).days <= 10)].recharge_amount.sum())
        assert row.recharge_trend == pytest.approx(polyfit(days, r.recharge_amount.values), abs=1e-6)
        daily = s.groupby("event_date").data_mb_used.sum()
        assert row.data_usage_trend == pytest.approx(polyfit([(d - last).days for d in daily.index], daily.values), abs=1e-6)
        assert row.active_days_90d == g.event_date.nunique()
        counts = g.channel.value_counts()
        assert row.preferred_channel == sorted(counts[counts == counts.max()].index)[0]
        assert row.offers_presented == (g.offer_presented == "X").sum()
        assert row.offers_accepted == g.offer_accepted.isin(["True", "1"]).sum()
        if len(r):
            seq = r.sort_values(["event_date", "recharge_amount"]).recharge_amount.values
            assert ordinal.loc[who].recharge_trend == pytest.approx(polyfit(range(1, len(seq) + 1), seq), abs=1e-6)


def test_drift_of_tied_values(spark):
    rng = np.random.default_rng(9)
    ref = pd.DataFrame({"a": np.where(rng.random(3000) < 0.5, 0.0, rng.normal(size=3000)), "b": 1.0})
    cur = pd.DataFrame({"a": np.where(rng.random(900) < 0.2, 0.0, rng.normal(0.4, 1, 900)), "b": 1.0})
    got = pytest.rows(drift.drift_report(spark.createDataFrame(ref), spark.createDataFrame(cur), ["a", "b"]), "feature_name")
    grid = np.unique(np.concatenate([ref.a, cur.a]))
    gap = np.abs(np.searchsorted(np.sort(ref.a), grid, "right") / 3000 - np.searchsorted(np.sort(cur.a), grid, "right") / 900)
    assert got["a"]["ks_statistic"] == pytest.approx(gap.max(), abs=1e-12)
    edges = np.linspace(ref.a.min(), ref.a.max(), 11)
    e = np.histogram(ref.a, edges)[0] / 3000 + 1e-4
    a = np.histogram(np.clip(cur.a, edges[0], edges[-1]), edges)[0] / 900 + 1e-4
    e, a = e / e.sum(), a / a.sum()
    assert got["a"]["psi"] == pytest.approx(np.sum((a - e) * np.log(a / e)), abs=1e-9)
    assert got["a"]["drift_detected"] and got["b"]["psi"] == 0 and not got["b"]["drift_detected"]
    assert got["b"]["ks_p_value"] == 1.0
