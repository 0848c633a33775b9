"""Errors, edges and invariants on computed data."""

import pytest
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.operators import alerts, campaigns, events, explain, metrics, profiles, reports, value
from subscope.sources import contracts, readers, sinks


def test_missing_columns_are_refused(spark, small):
    with pytest.raises(ValueError):
        value.rfm_scores(small[0])
    with pytest.raises(ValueError):
        contracts.require_columns(small[1], ["customer_id", "nope"])
    gone = contracts.schema_contract(small[0].drop("Churn"), K.PROFILE_COLUMNS)
    assert [r.column_name for r in gone.where("not present").collect()] == ["Churn"]


def test_key_integrity_names_both_sides(spark):
    p = spark.createDataFrame([("a",), ("b",)], "customer_id string")
    e = spark.createDataFrame([("b",), ("c",), ("c",)], "customer_id string")
    got = {(r.customer_id, r.only_in) for r in profiles.key_integrity(p, e).collect()}
    assert got == {("a", "profiles"), ("c", "events")}


def test_value_columns_in_range(master):
    bad = master.where(
        "r_score not between 1 and 5 or f_score not between 1 and 5 or m_score not between 1 and 5 "
        "or declining_recharge not in (0, 1) or long_silence not in (0, 1) or low_activity not in (0, 1) "
        "or arpu < 0 or rfm_segment is null or lifecycle_stage is null"
    )
    assert bad.count() == 0
    champions = master.where("rfm_segment = 'Champions' and (r_score < 4 or f_score < 4)")
    assert champions.count() == 0


def test_unknown_campaign(master):
    with pytest.raises(ValueError):
        campaigns.campaign(master, "nope")


@pytest.mark.parametrize("kind", K.CAMPAIGNS)
def test_campaign_lists(master, kind):
    full = campaigns.campaign(master, kind)
    rows = full.collect()
    assert full.columns == [f.split()[0] for f in campaigns.RECORD_SCHEMA.split(", ")]
    scores = [r.priority_score for r in rows]
    assert scores == sorted(scores, reverse=True)
    assert {r.recommended_channel for r in rows} <= {"SMS", "USSD", "PUSH_NOTIFICATION", "OUTBOUND_CALL"}
    capped = campaigns.campaign(master, kind, max_size=3).collect()
    assert [r.customer_id for r in capped] == [r.customer_id for r in rows[:3]]
    if kind == "churn_retention":
        assert all(r.churn_risk_score >= 0.65 for r in rows)
    if kind in ("bundle_upsell", "voice_topup"):
        assert all(r.churn_risk_score < 0.5 for r in rows)
        for r in rows:
            want = 0.7 * r.propensity_score + 0.3 * K.TIER_WEIGHT[r.clv_tier]
            assert r.priority_score == pytest.approx(want, abs=1e-12)


def test_top_n_orders_null_nan_and_ties_alike_for_every_n(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0), ("b", nan), ("c", None), ("d", 3.0), ("e", -inf), ("f", 3.0), ("g", inf), ("h", None)]
    df = spark.createDataFrame(rows, "customer_id string, x double")
    for n in (0, 1, 3, 5, 7, 8, 100):
        assert [r.customer_id for r in campaigns.top_n(df, "x", n).collect()] == list("bgdfaech")[:n]
    assert campaigns.top_n(df.where("false"), "x", 3).count() == 0


def test_undated_events_are_no_points_of_a_trend(spark):
    rows = [("1", "2024-01-01", "RECHARGE", 100.0), ("1", "2024-01-11", "RECHARGE", 200.0), ("1", None, "RECHARGE", 900.0)]
    rows += [("2", "2024-01-01", "DATA_SESSION", 5.0), ("2", "2024-01-03", "DATA_SESSION", 9.0), ("2", None, "DATA_SESSION", 70.0)]
    log = spark.createDataFrame(rows, "customer_id string, day string, event_type string, x double").selectExpr(
        "customer_id", "cast(day as date) event_date", "event_type", "if(event_type = 'RECHARGE', x, null) recharge_amount",
        "if(event_type = 'DATA_SESSION', x, null) data_mb_used", "'APP' channel", "cast(null as string) offer_presented", "'False' offer_accepted",
    )
    exact = log.withColumns({c: log[c].cast("decimal(18,2)") for c in ("recharge_amount", "data_mb_used")})
    for table in (log, exact):
        assert pytest.rows(events.recharge_trend(table), "customer_id")["1"]["recharge_trend"] == 10.0
        assert pytest.rows(events.data_usage_trend(table), "customer_id")["2"]["data_usage_trend"] == 2.0
        assert pytest.rows(events.trend_ordinal(table), "customer_id")["1"]["recharge_trend"] == 100.0
        both = pytest.rows(events.event_features(table), "customer_id")
        assert both["1"]["recharge_trend"] == 10.0 and both["2"]["data_usage_trend"] == 2.0


def test_constant_column_fills_the_middle_bin(spark):
    found = reports.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 5).orderBy("bin").collect()
    assert [r.n for r in found] == [0, 0, 2, 0, 0] and found[0].bin_start == 1.5


def test_suppression_and_summary(master):
    listed = campaigns.all_campaigns(master).select("customer_id").distinct()
    assert campaigns.all_campaigns(master, listed).count() == 0
    summary = pytest.rows(campaigns.campaign_summary(master), "campaign")
    counts = {r.campaign_name: r["count"] for r in campaigns.all_campaigns(master).groupBy("campaign_name").count().collect()}
    assert {k: v["eligible_customers"] for k, v in summary.items()} == {k: counts.get(k, 0) for k in K.CAMPAIGNS}
    empty = pytest.rows(campaigns.campaign_summary(master, listed), "campaign")
    assert all(v["eligible_customers"] == 0 and v["avg_propensity_score"] == 0 for v in empty.values())


def test_empty_export_keeps_header(spark, master, tmp_path):
    none = campaigns.campaign(master.where("false"), "voice_topup")
    path = sinks.write_opportunities(none, str(tmp_path), "voice_topup", "20240131")
    assert "campaign=voice_topup/dt=20240131" in path
    back = spark.read.csv(path, header=True)
    assert back.count() == 0 and back.columns == none.columns


def test_csv_scan_never_fails_on_bad_values(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(
        ",".join(K.EVENT_COLUMNS) + "\n1,2024-01-02,RECHARGE,12.5,,,APP,,True\n2,someday,RECHARGE,lots,,,APP,,1\n"
    )
    got = pytest.rows(readers.read_events(spark, str(path), "csv"), "customer_id")
    assert got["1"]["recharge_amount"] == 12.5
    assert got["2"]["event_date"] is None and got["2"]["recharge_amount"] is None


def test_customer_profile(master):
    assert profiles.customer_profile(master, "no such id").count() == 0
    row = profiles.customer_profile(master.drop("clv_tier"), "77").first()
    assert row.clv_tier == "Bronze" and row.ml_segment == "Dormant"


def test_cluster_labels(spark):
    cols = "cluster int, arpu double, recharge_count_30d double, days_since_last_recharge double, tenure_months double, churn_risk_score double"
    six = spark.createDataFrame(
        [(0, 9.0, 1.0, 50.0, 3.0, 0.1), (1, 8.0, 1.0, 5.0, 3.0, 0.1), (2, 1.0, 1.0, 5.0, 3.0, 0.9),
         (3, 1.0, 1.0, 5.0, 60.0, 0.2), (4, 1.0, 9.0, 5.0, 3.0, 0.1), (5, 1.0, 1.0, 5.0, 3.0, 0.1)], cols)
    got = {r.cluster: r.segment_label for r in explain.label_clusters(six).collect()}
    assert got == {0: "Dormant", 1: "High Value Active", 2: "At Risk Heavyweights", 3: "Loyal But Declining",
                   4: "Price Sensitive", 5: "Rising Stars"}
    two = {r.cluster: r.segment_label for r in explain.label_clusters(six.where("cluster < 2")).collect()}
    assert two == {0: "Segment 0", 1: "Segment 1"}


def test_quality_of_degenerate_scores(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, y int")
    assert metrics.auc_roc(df, "s", "y").first().auc_roc is None
    assert metrics.best_threshold(df, "s", "y") == 0.5
    assert metrics.classification_report(df, "s", "y", 0.5).first().precision == 0
    perfect = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.9, 1)], "s double, y int")
    assert metrics.auc_roc(perfect, "s", "y").first().auc_roc == 1
    assert metrics.average_precision(perfect, "s", "y").first().average_precision == 1


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert sum(r.n for r in reports.histogram(df, "x", 4).collect()) == 5


def test_alert_summary_without_alerts(spark):
    none = spark.createDataFrame([], alerts.ALERT_SCHEMA)
    got = alerts.alert_summary(none).collect()
    assert len(got) == 6 and all(r.alerts == 0 and r.latest_timestamp is None for r in got)


def test_arpu_tier_of_three(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "customer_id string, total_recharge_90d double")
    assert {r.arpu_tier for r in value.arpu_tier(value.with_arpu(df)).collect()} == {"Bronze"}


def test_rank_without_targets(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", None)], "customer_id string, s double")
    got = campaigns.priority_rank(df, "s").collect()
    assert len(got) == 2 and all(r.priority_rank == -1 and not r.targetable for r in got)


def test_top_factors_direction(spark):
    df = spark.createDataFrame([("a", 1.0, -3.0, 2.0)], "customer_id string, x double, y double, z double")
    cells = {c: F.col(c) for c in "xyz"}
    got = explain.top_factors(df, cells, 2).orderBy("position").collect()
    assert [(r.feature, r.direction) for r in got] == [("y", "decreasing"), ("z", "increasing")]
    assert df.select(explain.top_factor_names(cells).alias("n")).first().n == ["y", "z", "x"]


def test_mean_contributions(spark):
    found = spark.createDataFrame([([1.0, -2.0],), ([3.0, 0.0],)], "contributions array<double>")
    assert {r.feature_name: r.mean_abs_contribution for r in explain.mean_contributions(found, ["a", "b"]).collect()} == {"a": 2.0, "b": 1.0}


def test_rollup_store_grows_by_increments(spark, small, tmp_path):
    """Two increments, one written twice, with a late event of an old day and one without a date, give the features of the whole log."""
    from subscope.sources import rollups

    _, log = small
    extra = spark.createDataFrame([("1", None, "RECHARGE", 9.0, None, None, "APP", None, "False")], log.schema)
    log = log.union(extra)
    old = F.coalesce(F.col("event_date") < "2026-07-10", F.lit(True)) & (F.col("customer_id") != "3")
    path, packed = str(tmp_path / "store"), str(tmp_path / "packed")
    for name, part in (("a", log.where(old)), ("b", log.where(~old)), ("b", log.where(~old))):
        rollups.add_increment(part, path, name)
    rollups.compact(spark, path, packed)
    want = frame_of(events.event_features(log))
    for folder in (path, packed):
        assert frame_of(events.event_features(rollups.read_rollup(spark, folder))) == want
    window = events.event_features(rollups.read_rollup(spark, path, since="2026-07-15"), "2026-07-28")
    assert frame_of(window) == frame_of(events.event_features(log.where("event_date >= '2026-07-15'"), "2026-07-28"))


def frame_of(df):
    return sorted(map(str, df.collect()))


def test_metrics_of_several_models_together(spark):
    rows = [("a" if i % 2 else "b", (i * 37 % 50) / 50, int(i * 7 % 11 < 4)) for i in range(200)]
    long = spark.createDataFrame([*rows, ("a", None, 1), ("c", 0.5, 1)], "model string, score double, label int")
    got = pytest.rows(metrics.quality_each(long, {"a": 0.4, "b": 0.6, "c": 0.1}), "model")
    for model, cut in (("a", 0.4), ("b", 0.6)):
        one = long.where(F.col("model") == model)
        assert got[model]["rows"] == 100
        assert got[model]["auc_roc"] == pytest.approx(metrics.auc_roc(one, "score", "label").first()[0])
        assert got[model]["average_precision"] == pytest.approx(metrics.average_precision(one, "score", "label").first()[0])
        report = metrics.classification_report(one.where("score is not null"), "score", "label", cut).first().asDict()
        assert {k: got[model][k] for k in report} == pytest.approx(report)
    assert got["c"]["auc_roc"] is None and got["c"]["recall"] == 1.0


def test_small_p_values_stay_apart(spark):
    from subscope.functions.stats import ks_log10_p_value, ks_p_value

    df = spark.createDataFrame([(0.0, 100, 100), (0.05, 100, 100), (0.15, 100, 100), (0.3, 10_000, 10_000), (0.31, 10_000, 10_000), (0.9, 10**6, 10**6)], "s double, n long, m long")
    got = df.select(ks_p_value(F.col("s"), F.col("n"), F.col("m")).alias("p"), ks_log10_p_value(F.col("s"), F.col("n"), F.col("m")).alias("l")).collect()
    assert [r.l for r in got] == sorted((r.l for r in got), reverse=True) and got[3].l > got[4].l > got[5].l < -300_000
    for r in got[:4]:
        assert 10**r.l == pytest.approx(r.p, rel=1e-9)
    assert got[5].p == 0.0


def test_histograms_of_several_columns(spark):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, 5, None), (4.0, None, None)], "a double, b int, c double")
    got = {(r.column, r.bin): (r.bin_start, r.n) for r in reports.histograms(df, {"a": 3, "b": 2, "c": 1}).collect()}
    assert got == {("a", 0): (1.0, 1), ("a", 1): (2.0, 1), ("a", 2): (3.0, 1), ("b", 0): (4.5, 0), ("b", 1): (5.0, 2), ("c", 0): (None, 0)}


@pytest.mark.parametrize("size", [0, 3, 60])
def test_lists_together_and_alone(master, size):
    """A list is the same alone and among the others, cut or whole."""
    together = campaigns.all_campaigns(master, max_size=size).collect()
    alone = [r for k in K.CAMPAIGNS for r in campaigns.campaign(master, k, max_size=size).collect()]
    assert together == alone


def test_score_summary_of_few_and_no_customers(spark):
    schema = "churn_risk_score double, ml_segment string, propensity_bundle double, propensity_topup double, clv_tier string"
    rows = [(0.9, "A", 0.2, None, "Gold"), (0.8, "A", 0.4, None, "Gold"), (0.65, None, None, None, None), (None, "B", 0.9, None, "Bronze")]
    found = {(r.section, r.name): (r.customers, r.mean) for r in reports.score_summary(spark.createDataFrame(rows, schema)).collect()}
    assert found == {
        ("all", "customers"): (4, None), ("churn_risk", "Critical"): (1, None), ("churn_risk", "High"): (1, None),
        ("segment", "A"): (2, None), ("segment", "B"): (1, None),
        ("clv_tier", "Platinum"): (0, None), ("clv_tier", "Gold"): (2, None), ("clv_tier", "Silver"): (0, None), ("clv_tier", "Bronze"): (1, None),
        ("propensity", "propensity_bundle"): (3, pytest.approx(0.5)), ("propensity", "propensity_topup"): (0, None),
    }
    assert {r.customers for r in reports.score_summary(spark.createDataFrame([], schema)).collect()} == {0}
