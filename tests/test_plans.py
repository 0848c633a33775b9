"""Properties of physical plans that matter on large inputs."""

import re

import pytest

import __spark_entry__ as entry_module
from subscope.operators import campaigns, events, ordering
from subscope.plans import fixtures
from subscope.session import materialize

QUERIES = entry_module.queries()
FLAGSHIP = [
    "event_features", "feature_store_batch", "feature_store_ordinal", "rfm_behaviour_store", "rfm_scores",
    "arpu_tier", "upsell_signals", "recharge_trend_ordinal", "preferred_channel", "activity_agg",
    "campaign_all", "campaign_summary", "propensity_priority_rank", "drift_report", "auc_roc",
    "stratified_split", "soft_assignment", "top_risk_factors", "clv_tier_budget",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", FLAGSHIP)
def test_no_cross_joins_and_no_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", ["rfm_scores", "arpu_tier", "upsell_signals", "stratified_split", "clv_tier_budget"])
def test_scores_are_projections(name, spark, sf_dir):
    """Bins and thresholds are literals: labelling moves no row."""
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text and "Window" not in text


def test_event_scan_is_pruned(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    log = materialize(fixtures.event_log(spark, sf_dir), "log")
    text = plan(events.preferred_channel(log))
    assert "ReadSchema: struct<customer_id:string,channel:string>" in text
    text = plan(events.filter_events(log, "RECHARGE", ref="2000-12-31", days=30))
    assert "EqualTo(event_type,RECHARGE)" in text and "GreaterThanOrEqual(event_date" in text


def test_log_is_aggregated_before_it_moves(spark, sf_dir):
    """Every exchange of the event block sits on a partial aggregate, and no sort is global."""
    text = plan(events.event_block(materialize(fixtures.event_log(spark, sf_dir), "log"), ref="2000-12-31"))
    below = re.findall(r"Exchange hashpartitioning.*\n\W*(\w+)", text)
    assert below and set(below) <= {"HashAggregate", "SortAggregate"}
    assert "rangepartitioning" not in text and "SinglePartition" not in text


def test_log_is_joined_and_scanned_once(spark, sf_dir):
    """Features of the log as it comes: its rollup scans each table once (orders twice, as both kinds of events have them),
    and all else reads the rollup."""
    log = fixtures.event_log(spark, sf_dir)
    assert plan(events.channel_rollup(log)).count("Scan parquet") == 3
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(events.event_features(log))
    assert "Scan parquet" in text and "orders.parquet" not in text and "lineitem.parquet" not in text
    assert plan(events.recharge_trend(log)).count("Scan parquet") == 1


def test_lists_share_one_scan(spark, master):
    text = plan(campaigns.all_campaigns(master))
    assert text.count("Scan parquet") == 1


def test_long_list_has_no_single_task_limit(master):
    text = plan(campaigns.top_n(master, "clv_90d", 20))
    assert "TakeOrderedAndProject" not in text and "GlobalLimit" not in text


def test_ranking_windows_are_partitioned(spark, master):
    text = plan(ordering.global_rank(master.select("clv_90d", "customer_id"), ["clv_90d", "customer_id"], "r"))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", text)
    assert any("_range" in w for w in windows)
