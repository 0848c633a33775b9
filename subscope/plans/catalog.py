"""Registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subscope import constants as K
from subscope.functions import cleaning, rules
from subscope.models import attribution, churn, clv, evaluation, matrix, persist, propensity, rounds, scoring, segments
from subscope.operators import (
    alerts, campaigns, drift, encoding, events, explain, metrics, ordering, profiles, reports, value,
)
from subscope.plans import flows, monitoring
from subscope.plans.fixtures import (
    AMOUNT_COLUMNS, BATCH_FEATURES, DIGITS, PERFORMANCE, QUERY_CUSTOMER, STAMP, UNROUNDED, WINDOW_DAYS, ZCOLS, batch, event_log,
    master, rollup, store,
)
from subscope.session import materialize, scratch_path, side_by_side
from subscope.sources import adapters as A
from subscope.sources import contracts, readers, rollups, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles so that another engine's summation order does not show; dates as text."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            value_ = F.col(f.name) if f.name in UNROUNDED else F.round(f.name, DIGITS.get(f.name, 6))
            out[f.name] = value_ + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.col(f.name).cast("string")
    return df.withColumns(out) if out else df


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        return fn

    return register


def _clicks(s: SparkSession, d: str) -> DataFrame:
    return A.adapt(s, d, A.CLICK_LOG)


def _raw(s: SparkSession, d: str) -> DataFrame:
    return A.adapt(s, d, A.PROFILES)


def _prof(s: SparkSession, d: str) -> DataFrame:
    return encoding.normalize_profile(encoding.clean_profiles(_raw(s, d)))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return A.adapt(s, d, A.SCORES)


def _suppressed(s: SparkSession, d: str) -> DataFrame:
    return A.adapt(s, d, A.SUPPRESSION)


# scans, sources, sinks, data quality


@query("scan_profiles")
def _(s, d):
    path = scratch_path(s, "profiles-csv")
    _raw(s, d).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_profiles(s, path, "csv")


@query("scan_events")
def _(s, d):
    path = scratch_path(s, "events-parquet")
    log = event_log(s, d).withColumns({c: F.col(c).cast("double") for c in ("recharge_amount", "data_mb_used")})
    log.write.parquet(path)
    return readers.read_events(s, path)


@query("schema_contract")
def _(s, d):
    return contracts.schema_contract(_raw(s, d), K.PROFILE_COLUMNS)


@query("coerce_types")
def _(s, d):
    return cleaning.coerce_types(A.adapt(s, d, A.RAW_TEXT), {"event_date": "date", "amount": "double"})


@query("clean_keys_and_labels")
def _(s, d):
    return encoding.clean_profiles(_raw(s, d)).select("customerID", "SeniorCitizen", "TotalCharges", "churn_label")


@query("value_distribution")
def _(s, d):
    return profiles.value_distribution(_clicks(s, d), "event_type")


@query("key_integrity")
def _(s, d):
    return profiles.key_integrity(_prof(s, d), event_log(s, d))


@query("feature_store_roundtrip")
def _(s, d):
    path = scratch_path(s, "store-csv")
    sinks.write_store(store(s, d), path, "csv")
    return readers.read_store(s, path, "csv", store(s, d).schema)


@query("rfm_export")
def _(s, d):
    return sinks.rfm_export(value.rfm_scores(store(s, d)))


@query("opportunity_export")
def _(s, d):
    path = scratch_path(s, "lists")
    listed = campaigns.campaign(master(s, d), "bundle_upsell", _suppressed(s, d))
    return sinks.read_opportunities(s, sinks.write_opportunities(listed, path, "bundle_upsell", "20240131"))


@query("alert_log_roundtrip")
def _(s, d):
    path = scratch_path(s, "alerts-json")
    sinks.write_alerts(_all_alerts(s, d), path)
    return sinks.read_alerts(s, path)


# projections, filters, scalar expressions


@query("normalize_profile")
def _(s, d):
    return _prof(s, d).select(
        "customer_id", "tenure_months", "monthly_charges", "total_charges", "churn_label",
        *[F.col(c).cast("double").alias(c) for c in (*K.YES_NO_COLUMNS, *K.ADD_ON_COLUMNS)],
    )


@query("one_hot_fixed")
def _(s, d):
    joined = profiles.join_features(_prof(s, d), events.preferred_channel(event_log(s, d)))
    names = [n for spec in K.INDICATORS.values() for n in spec]
    return encoding.one_hot_fixed(joined).select("customer_id", *names)


@query("one_hot_dynamic")
def _(s, d):
    wide = encoding.one_hot_dynamic(_prof(s, d), "MultipleLines")
    return wide.select("customer_id", *[c for c in wide.columns if c.startswith("MultipleLines_")])


@query("fill_missing")
def _(s, d):
    joined = profiles.join_features(_prof(s, d), events.preferred_channel(event_log(s, d)))
    return encoding.fill_missing(joined).select(
        "customer_id", "total_charges", "Dependents", "StreamingMovies", "preferred_channel"
    )


@query("fill_defaults")
def _(s, d):
    joined = profiles.join_features(
        _prof(s, d).select("customer_id"), events.event_block(event_log(s, d))
    )
    return events.fill_defaults(joined, K.EVENT_DEFAULTS).select("customer_id", *K.EVENT_DEFAULTS)


@query("event_filters")
def _(s, d):
    return events.filter_events(event_log(s, d), "RECHARGE", days=30).select(
        "customer_id", "event_date", "recharge_amount"
    )


@query("offer_flags")
def _(s, d):
    return events.offer_flags(_clicks(s, d)).select(
        "customer_id", "event_date", "event_type", "has_offer", "is_accepted"
    )


@query("numeric_feature_matrix")
def _(s, d):
    m = master(s, d)
    names = _features(m)
    cells = vector_to_array("features")
    return matrix.feature_vector(m, names).select(
        "customer_id", *[cells[i].alias(c) for i, c in enumerate(names)]
    )


@query("arpu")
def _(s, d):
    return value.with_arpu(store(s, d)).select("customer_id", "arpu")


@query("engagement_score")
def _(s, d):
    return value.with_engagement(store(s, d)).select("customer_id", "engagement_score")


@query("churn_signals")
def _(s, d):
    return value.with_churn_signals(store(s, d)).select(
        "customer_id", "declining_recharge", "long_silence", "low_activity", "recharge_drop_flag"
    )


@query("upsell_signals")
def _(s, d):
    tiers = value.arpu_tier(value.with_arpu(store(s, d)))
    return value.with_upsell_signals(tiers).select(
        "customer_id", "high_data_user", "frequent_recharger", "high_offer_responder", "app_user", "premium_customer"
    )


@query("lifecycle_stage")
def _(s, d):
    return value.with_lifecycle(value.with_arpu(store(s, d))).select("customer_id", "lifecycle_stage")


@query("risk_tier_action")
def _(s, d):
    score = F.col("churn_risk_score")
    return _scores(s, d).select(
        "customer_id", score, rules.risk_tier(score).alias("risk_tier"),
        rules.risk_action(score).alias("recommended_action"),
    )


@query("response_rate")
def _(s, d):
    return _scores(s, d).select(
        "customer_id", rules.response_rate(F.col("propensity_bundle")).alias("estimated_response_rate")
    )


@query("recommend_channel")
def _(s, d):
    m = master(s, d)
    return m.select("customer_id", rules.recommend_channel(m).alias("recommended_channel"))


@query("clv_tier_budget")
def _(s, d):
    m = master(s, d)
    scaled = m.select("customer_id", (F.col("clv_90d") * 50.0).alias("clv_90d"))
    return value.with_clv_tier(scaled, value.clv_thresholds(m))


@query("clv_target")
def _(s, d):
    return value.clv_target(master(s, d)).select(
        "customer_id", "clv_log_target", rules.clv_back_transform(F.col("clv_log_target")).alias("clv_back")
    )


@query("customer_profile")
def _(s, d):
    return profiles.customer_profile(master(s, d), QUERY_CUSTOMER)


# joins


@query("profile_left_join")
def _(s, d):
    joined = profiles.join_features(_prof(s, d), events.event_features(event_log(s, d)))
    return joined.select(
        "customer_id", "tenure_months", "monthly_charges",
        F.col("recharge_count_90d").cast("double").alias("recharge_count_90d"),
        "total_recharge_90d", "preferred_channel",
    )


@query("feature_block_joins")
def _(s, d):
    log = events.stored_rollup(event_log(s, d))
    act = events.activity_agg(log).select("customer_id", "total_events_count", "active_days_90d")
    rec = events.recharge_agg(log).select("customer_id", F.col("recharge_count").cast("double").alias("recharge_count"), "total_recharge")
    return act.join(rec, "customer_id", "left").join(events.preferred_channel(log), "customer_id", "left")


@query("customers_without_events")
def _(s, d):
    return profiles.customers_without_events(_prof(s, d), event_log(s, d)).select("customer_id", "tenure_months")


@query("suppression_anti_join")
def _(s, d):
    return profiles.suppress(_scores(s, d), _suppressed(s, d)).select("customer_id", "churn_risk_score")


@query("dictionary_lookup")
def _(s, d):
    weighted = profiles.lookup(_scores(s, d), "clv_tier", K.TIER_WEIGHT, 0.25, "tier_weight")
    return profiles.lookup(weighted, "clv_tier", K.TIER_BUDGET, "Minimal", "retention_budget").select(
        "customer_id", "clv_tier", "tier_weight", "retention_budget"
    )


# aggregations


@query("activity_agg")
def _(s, d):
    return events.activity_agg(event_log(s, d))


@query("recharge_agg_90d")
def _(s, d):
    return events.recharge_agg(event_log(s, d))


@query("recharge_agg_30d")
def _(s, d):
    # the cutoff counts back from the last day of the whole log
    recent = events.recharge_agg(event_log(s, d), window_days=30)
    return recent.select(
        "customer_id",
        F.col("recharge_count").alias("recharge_count_30d"),
        F.col("total_recharge").alias("total_recharge_30d"),
    )


@query("data_usage_agg")
def _(s, d):
    return events.data_usage_agg(event_log(s, d))


@query("offer_acceptance_rate")
def _(s, d):
    return events.offer_acceptance(_clicks(s, d))


@query("app_usage_rate")
def _(s, d):
    return events.app_usage_rate(event_log(s, d))


@query("preferred_channel")
def _(s, d):
    return events.preferred_channel(_clicks(s, d))


@query("recharge_trend")
def _(s, d):
    return events.recharge_trend(event_log(s, d))


@query("data_usage_trend")
def _(s, d):
    return events.data_usage_trend(event_log(s, d))


@query("recharge_trend_ordinal")
def _(s, d):
    return events.trend_ordinal(event_log(s, d))


@query("reference_dates")
def _(s, d):
    return events.reference_dates(event_log(s, d))


@query("feature_quantiles")
def _(s, d):
    m = master(s, d)
    points = [0.2, 0.25, 0.5, 0.75, 0.9]
    found = ordering.quantiles(m, {c: points for c in AMOUNT_COLUMNS})
    rows = [
        F.struct(
            F.lit(c).alias("feature_name"),
            *[F.lit(found[c][p]).cast("double").alias(f"p{round(p * 100)}") for p in points],
        )
        for c in AMOUNT_COLUMNS
    ]
    return s.range(1).select(F.inline(F.array(*rows)))


@query("rfm_segment_profiles")
def _(s, d):
    return reports.segment_profiles(master(s, d))


@query("cluster_profiles")
def _(s, d):
    return reports.cluster_profiles(master(s, d))


@query("clv_tier_summary")
def _(s, d):
    return reports.clv_tier_summary(master(s, d))


@query("segment_counts")
def _(s, d):
    return reports.segment_counts(master(s, d), "rfm_segment")


@query("lifecycle_funnel")
def _(s, d):
    return reports.lifecycle_funnel(master(s, d))


@query("rfm_heatmap")
def _(s, d):
    return reports.rfm_heatmap(master(s, d))


@query("score_histogram")
def _(s, d):
    m = master(s, d)
    bins = {
        "churn_risk_score": 20, "propensity_bundle": 15, "propensity_topup": 15, "propensity_reactivation": 15,
    }
    return reports.histograms(m, bins, "score")


@query("kpi_summary")
def _(s, d):
    return reports.kpi_summary(master(s, d), _suppressed(s, d))


@query("score_summary")
def _(s, d):
    return reports.score_summary(master(s, d), "rfm_segment")


@query("campaign_summary")
def _(s, d):
    return campaigns.campaign_summary(master(s, d), _suppressed(s, d))


@query("channel_reach")
def _(s, d):
    return campaigns.channel_reach(campaigns.all_campaigns(master(s, d), _suppressed(s, d)))


@query("class_balance")
def _(s, d):
    return metrics.class_balance(master(s, d), "churn_label")


# ranking, sort, limit


@query("rfm_scores")
def _(s, d):
    return value.rfm_scores(store(s, d)).select("customer_id", "r_score", "f_score", "m_score", "rfm_score")


@query("rfm_segment")
def _(s, d):
    return value.with_rfm_segment(value.rfm_scores(store(s, d))).select("customer_id", "rfm_score", "rfm_segment")


@query("arpu_tier")
def _(s, d):
    return value.arpu_tier(value.with_arpu(store(s, d))).select("customer_id", "arpu_tier")


@query("propensity_priority_rank")
def _(s, d):
    return campaigns.priority_rank(_scores(s, d), "propensity_bundle").select(
        "customer_id", "propensity_bundle", "targetable", "priority_rank"
    )


@query("campaign_top_n")
def _(s, d):
    return campaigns.top_n(_scores(s, d), "clv_90d", 100).select("customer_id", "clv_90d")


@query("at_risk_customers")
def _(s, d):
    return profiles.at_risk(master(s, d))


@query("top_risk_factors")
def _(s, d):
    z = metrics.standardize(master(s, d), ZCOLS)
    return explain.top_factors(z, {c: F.round(F.col(f"{c}_z"), 6) + F.lit(0.0) for c in ZCOLS}, 3)


@query("cluster_label_assignment")
def _(s, d):
    return explain.label_clusters(reports.cluster_profiles(master(s, d)))


# campaigns


def _campaign_query(kind: str) -> None:
    @query(f"campaign_{kind}")
    def _(s, d):
        return campaigns.campaign(master(s, d), kind, _suppressed(s, d))


for _kind in K.CAMPAIGNS:
    _campaign_query(_kind)


@query("campaign_all")
def _(s, d):
    return campaigns.all_campaigns(master(s, d), _suppressed(s, d))


# metrics


@query("f1_threshold_sweep")
def _(s, d):
    return metrics.f1_sweep(master(s, d), "churn_risk_score", "churn_label")


@query("auc_roc")
def _(s, d):
    return metrics.auc_roc(master(s, d), "churn_risk_score", "churn_label")


@query("average_precision")
def _(s, d):
    return metrics.average_precision(master(s, d), "churn_risk_score", "churn_label")


@query("classification_report")
def _(s, d):
    return metrics.classification_report(master(s, d), "churn_risk_score", "churn_label", 0.4)


@query("standardize")
def _(s, d):
    return metrics.standardize(master(s, d), ZCOLS).select("customer_id", *[f"{c}_z" for c in ZCOLS])


@query("soft_assignment")
def _(s, d):
    cols = [f"{c}_z" for c in ZCOLS]
    z = metrics.standardize(master(s, d), ZCOLS)
    centres = z.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols]).orderBy("cluster").collect()
    return metrics.soft_assign(z, cols, [[r[c] for c in cols] for r in centres]).select(
        "customer_id", *[f"weight_{i}" for i in range(len(centres))]
    )


@query("propensity_labels")
def _(s, d):
    return value.propensity_labels(master(s, d)).select(
        "customer_id", "label_bundle_upgrade", "label_voice_topup", "label_reactivation"
    )


@query("regression_metrics")
def _(s, d):
    m = master(s, d).withColumn("predicted", F.col("clv_90d") * 100.0)
    return metrics.regression_metrics(m, "total_recharge_90d", "predicted")


# drift and alerts


def _batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reference and current: two successive windows of the log."""
    return batch(s, d, earlier=True), batch(s, d, earlier=False)


def _report(s: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(*_batches(s, d), BATCH_FEATURES)


def _score_report(s: SparkSession, d: str) -> DataFrame:
    return drift.prediction_drift(*_batches(s, d), "churn_risk_score")


def _model_aucs(s: SparkSession, d: str) -> DataFrame:
    """Both batches and all scores in one ranking."""
    named = [
        df.select("churn_label", *[F.col(c).alias(f"{c}:{side}") for c in PERFORMANCE]) for df, side in zip(_batches(s, d), ("ref", "cur"))
    ]
    both = named[0].unionByName(named[1], allowMissingColumns=True)
    found = metrics.auc_roc_each(both, [f"{c}:{side}" for c in PERFORMANCE for side in ("ref", "cur")], "churn_label")
    name, side = F.split("score_name", ":")[0], F.split("score_name", ":")[1]
    return found.groupBy(rules.lookup(name, PERFORMANCE, None).alias("model_name")).agg(
        F.max(F.when(side == "ref", F.col("auc_roc"))).alias("reference_auc"),
        F.max(F.when(side == "cur", F.col("auc_roc"))).alias("current_auc"),
    )


def _all_alerts(s: SparkSession, d: str) -> DataFrame:
    return alerts.all_alerts(
        alerts.feature_alerts(_report(s, d), STAMP),
        alerts.prediction_alerts(_score_report(s, d), STAMP),
        alerts.performance_alerts(_model_aucs(s, d), STAMP),
    )


@query("reference_stats")
def _(s, d):
    return drift.reference_stats(batch(s, d, earlier=True), BATCH_FEATURES)


@query("psi")
def _(s, d):
    return drift.psi(*_batches(s, d), BATCH_FEATURES)


@query("ks_statistic")
def _(s, d):
    return drift.ks_statistic(*_batches(s, d), BATCH_FEATURES)


@query("ks_p_value")
def _(s, d):
    return drift.ks_test(*_batches(s, d), BATCH_FEATURES)


@query("drift_report")
def _(s, d):
    return _report(s, d)


@query("prediction_drift")
def _(s, d):
    return _score_report(s, d)


@query("feature_drift_alerts")
def _(s, d):
    return alerts.feature_alerts(_report(s, d), STAMP)


@query("prediction_drift_alerts")
def _(s, d):
    return alerts.prediction_alerts(_score_report(s, d), STAMP)


@query("performance_drop_alerts")
def _(s, d):
    return alerts.performance_alerts(_model_aucs(s, d), STAMP)


@query("alert_union")
def _(s, d):
    return _all_alerts(s, d)


@query("alert_summary")
def _(s, d):
    return alerts.alert_summary(materialize(_all_alerts(s, d), "alerts"))


@query("seeded_sample")
def _(s, d):
    return drift.seeded_sample(_scores(s, d), 0.2).select("customer_id", "churn_risk_score")


# end-to-end flows


@query("event_features")
def _(s, d):
    return events.event_features(event_log(s, d))


@query("feature_store_batch")
def _(s, d):
    return flows.feature_store(_raw(s, d), event_log(s, d))


@query("feature_store_incremental")
def _(s, d):
    """The store from two increments of the log, the later one of its last year."""
    log, path = event_log(s, d), scratch_path(s, "rollups")
    late = F.coalesce(F.col("event_date") > F.date_sub(events.reference_dates(log).select("max_date").scalar(), 365), F.lit(False))
    rollups.add_increment(log.where(~late), path, "first")
    rollups.add_increment(log.where(late), path, "second")
    return flows.feature_store(_raw(s, d), rollups.read_rollup(s, path))


@query("feature_store_ordinal")
def _(s, d):
    wide = flows.feature_store_ordinal(_raw(s, d), event_log(s, d))
    return wide.select(
        "customer_id", "tenure", "MonthlyCharges", "TotalCharges", "churn_label", *K.ORDINAL_DEFAULTS
    )


@query("rfm_behaviour_store")
def _(s, d):
    return flows.value_store(_raw(s, d), event_log(s, d))


# models


def _features(m: DataFrame) -> list[str]:
    return encoding.numeric_columns(m, [*K.NON_FEATURES, "cluster"])


@query("stratified_split")
def _(s, d):
    return matrix.mark_split(_prof(s, d), "churn_label").select("customer_id", "churn_label", "is_test")


_fitted: dict[tuple[str, str, str], object] = {}


def _shared(s: SparkSession, d: str, name: str, fit: Callable[[], object]) -> object:
    """A model is fitted once per application and folder; its queries share it."""
    key = (s.sparkContext.applicationId, d, name)
    found = _fitted.get(key)
    if found is None:
        found = _fitted[key] = fit()
    return found


def _churn_fit(s: SparkSession, d: str) -> churn.Fit:
    m = master(s, d)
    return _shared(s, d, "churn", lambda: churn.fit_rounds(matrix.mark_split(m, "churn_label"), _features(m)))


def _churn_model(s: SparkSession, d: str) -> tuple[PipelineModel, DataFrame, list[str]]:
    m = master(s, d)
    return _churn_fit(s, d).model, m.drop("churn_risk_score"), _features(m)


def _segment_model(s: SparkSession, d: str) -> PipelineModel:
    m = master(s, d)
    return _shared(s, d, "segments", lambda: segments.fit_segments(m, _features(m)))


def _propensity_models(s: SparkSession, d: str) -> dict[str, PipelineModel]:
    def fit() -> dict[str, PipelineModel]:
        m = master(s, d)
        labelled = materialize(value.propensity_labels(m), "labelled")

        def one(offer: str) -> PipelineModel:
            return propensity.fit_propensity(matrix.stratified_split(labelled, propensity.OFFERS[offer][0])[0], offer, _features(m))

        found = side_by_side([partial(one, offer) for offer in propensity.OFFERS], matrix.fits_at_once(labelled))
        return dict(zip(propensity.OFFERS, found))

    return _shared(s, d, "propensity", fit)


def _clv_model(s: SparkSession, d: str) -> PipelineModel:
    m = master(s, d)
    return _shared(s, d, "clv", lambda: clv.fit_clv(m, _features(m)))


def _all_models(s: SparkSession, d: str) -> scoring.Models:
    m = master(s, d)
    return _shared(s, d, "all", lambda: scoring.fit_all(m, _features(m)))


def _churn_scores(s: SparkSession, d: str) -> DataFrame:
    model, m, names = _churn_model(s, d)
    held_out = matrix.mark_split(m, "churn_label").where("is_test")
    factors = explain.top_factor_names(attribution.contribution_columns(names)).alias("top_risk_factors")
    found = attribution.attribute(model, m).select("customer_id", factors)
    return churn.score_churn(model, m, churn.tuned_threshold(model, held_out)).join(found, "customer_id")


def _propensity_scores(s: SparkSession, d: str) -> DataFrame:
    m = master(s, d)
    parts = [
        propensity.score_propensity(model, m).withColumn("offer_type", F.lit(offer)) for offer, model in _propensity_models(s, d).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _clv_scores(s: SparkSession, d: str) -> DataFrame:
    m = master(s, d)
    return clv.score_clv(_clv_model(s, d), m.drop("clv_90d"), value.clv_thresholds(m))


def _fold_r2(s: SparkSession, d: str) -> list[float]:
    m = master(s, d)
    return _shared(s, d, "folds", lambda: clv.fold_r2(m, _features(m)))


def _segmented(s: SparkSession, d: str) -> DataFrame:
    return segments.assign_segments(_segment_model(s, d), master(s, d).drop("cluster"))


@query("churn_model_scores")
def _(s, d):
    return _churn_scores(s, d)


@query("churn_attribution")
def _(s, d):
    model, m, names = _churn_model(s, d)
    found = attribution.attribute(model, m)
    return explain.top_factors(found, attribution.contribution_columns(names), 5)


@query("churn_attribution_summary")
def _(s, d):
    model, m, names = _churn_model(s, d)
    return explain.mean_contributions(attribution.attribute(model, m), names)


@query("churn_explanation")
def _(s, d):
    model, m, names = _churn_model(s, d)
    one = m.where(F.col("customer_id") == QUERY_CUSTOMER)  # filtered before anything is attributed
    return explain.top_factors(attribution.attribute(model, one), attribution.contribution_columns(names), 5)


@query("model_roundtrip")
def _(s, d):
    model, m, _ = _churn_model(s, d)
    path = scratch_path(s, "model")
    persist.save_model(model, path)
    return churn.score_churn(persist.load_model(path), m)


@query("kmeans_segments")
def _(s, d):
    return _segmented(s, d).select(
        "customer_id", "cluster", "segment_label", "description", "recommended_campaign"
    )


@query("silhouette")
def _(s, d):
    z = metrics.standardize(master(s, d), ZCOLS)
    found = segments.silhouette(z, [f"{c}_z" for c in ZCOLS])
    return s.range(1).select(F.lit(found).alias("silhouette"))


@query("k_selection")
def _(s, d):
    m = master(s, d)
    return segments.k_selection(m, _features(m))


@query("pca_2d")
def _(s, d):
    m = master(s, d)
    return segments.pca_2d(m, _features(m))


@query("propensity_scores")
def _(s, d):
    return _propensity_scores(s, d)


@query("clv_scores")
def _(s, d):
    return _clv_scores(s, d)


@query("cv_r2")
def _(s, d):
    m = master(s, d)
    found = clv.cv_r2(m, _features(m))
    return s.range(1).select(F.lit(found).alias("cv_r2"))


@query("score_all_models")
def _(s, d):
    return scoring.score_all(_all_models(s, d), master(s, d))


@query("model_evaluation")
def _(s, d):
    return evaluation.evaluate(_all_models(s, d), master(s, d))


# what must hold for fitted models, whatever they have learned: counts that another engine can work out


def _counts(df: DataFrame, **rules: Column) -> DataFrame:
    """Number of customers, and of those for whom each rule holds."""
    return df.agg(F.count(F.lit(1)).alias("customers"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


@query("model_roundtrip_check")
def _(s, d):
    model, m, _ = _churn_model(s, d)
    path = scratch_path(s, "model")
    persist.save_model(model, path)
    before, after = churn.score_churn(model, m), churn.score_churn(persist.load_model(path), m)
    both = before.alias("a").join(after.alias("b"), "customer_id", "full")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in before.columns if c != "customer_id"])
    return _counts(both, unchanged=same)


@query("churn_model_check")
def _(s, d):
    fit, m = _churn_fit(s, d), master(s, d).drop("churn_risk_score")
    kept, quality = len(fit.model.stages[-1].treeWeights), fit.quality
    score, cut = F.col("churn_risk_score"), churn.tuned_threshold(fit.model, matrix.mark_split(m, "churn_label").where("is_test"))
    found = _counts(
        churn.score_churn(fit.model, m, cut), in_range=score.between(0, 1), flag_follows=F.col("churn_predicted") == (score >= cut),
        tier_follows=F.col("risk_tier") == rules.risk_tier(score), action_follows=F.col("recommended_action") == rules.risk_action(score),
    )
    upto, after = quality[:kept], quality[kept : kept + rounds.PATIENCE]
    patient = len(after) == rounds.PATIENCE or len(quality) == 300
    return found.withColumns(
        {
            "no_better_round": F.lit(all(q < upto[-1] for q in upto[:-1]) and all(q <= upto[-1] for q in after)),
            "patience_kept": F.lit(patient),
        }
    )


@query("churn_attribution_check")
def _(s, d):
    model, m, _ = _churn_model(s, d)
    found = attribution.attribute(model, m).join(churn.churn_probability(model, m).select("customer_id", "churn_risk_score"), "customer_id")
    margin = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    return _counts(found, adds_up=F.abs(1 / (1 + F.exp(-2 * margin)) - F.col("churn_risk_score")) < 1e-9)


@query("kmeans_segments_check")
def _(s, d):
    model = _segment_model(s, d)
    rows = model.transform(master(s, d).drop("cluster")).select("cluster", vector_to_array("features").alias("x"))
    centres = [F.array(*[F.lit(float(v)) for v in c]) for c in model.stages[-1].clusterCenters()]
    apart = F.array(*[F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v) for c in centres])
    found = _counts(rows, at_nearest=F.element_at(apart, F.col("cluster") + 1) <= F.array_min(apart) + 1e-6)
    texts = _segmented(s, d).agg(F.count_distinct("cluster").alias("clusters"), F.count_distinct("segment_label").alias("labels"))
    return found.withColumns({c: texts.select(c).scalar() for c in ("clusters", "labels")})


@query("k_selection_check")
def _(s, d):
    m = master(s, d)
    names = _features(m)
    found = segments.k_selection(m, names)
    total = sum(m.agg(*[F.var_pop(c) * F.count(c) for c in names]).first())
    best = F.max_by("is_best", F.struct("silhouette", -F.col("k")))
    return found.agg(
        F.min("k").alias("smallest"), F.max("k").alias("largest"), F.count_if("is_best").alias("best"), best.alias("best_on_top"),
        F.count_if(F.col("inertia").between(0, total)).alias("below_total"), F.count_if(F.abs("silhouette") <= 1).alias("in_range"),
    )


@query("propensity_scores_check")
def _(s, d):
    score, rank, on = F.col("propensity_score"), F.col("priority_rank"), F.col("targetable")
    return _propensity_scores(s, d).groupBy("offer_type").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(score.between(0, 1)).alias("in_range"),
        F.count_if(on == (score >= K.PROPENSITY_THRESHOLD)).alias("flag_follows"), F.count_if(on == (rank > 0)).alias("rank_follows"),
        (F.coalesce(F.max(F.when(on, rank)), F.lit(0)) - F.count_distinct(F.when(on, rank))).alias("gaps"),
    )


@query("clv_scores_check")
def _(s, d):
    cut, v = value.clv_thresholds(master(s, d)), F.col("clv_90d")
    return _counts(
        _clv_scores(s, d), not_negative=v >= 0, tier_follows=F.col("clv_tier") == rules.clv_tier(v, *(cut[p] for p in (0.5, 0.75, 0.9))),
        budget_follows=F.col("retention_budget_tier") == rules.lookup(F.col("clv_tier"), K.TIER_BUDGET, "Minimal"),
        month_follows=F.abs(F.col("monthly_arpu_estimate") * 3 - v) < 1e-6,
    )


@query("cv_r2_check")
def _(s, d):
    found = _fold_r2(s, d)
    folds = matrix.contiguous_folds(master(s, d)).groupBy("fold").agg(
        F.count(F.lit(1)).alias("customers"), F.min("customer_id").alias("first_id"), F.max("customer_id").alias("last_id")
    )
    return folds.withColumn("r2_in_range", F.get(F.array(*[F.lit(r <= 1) for r in found]), F.col("fold")))


@query("score_all_models_check")
def _(s, d):
    models, m = _all_models(s, d), master(s, d)
    alone = churn.churn_probability(models.churn, m.drop("churn_risk_score")).select("customer_id", F.col("churn_risk_score").alias("alone"))
    score, v = F.col("churn_risk_score"), F.col("predicted_clv_90d")
    return _counts(
        scoring.score_all(models, m).join(alone, "customer_id"), same_alone=score == F.col("alone"),
        flag_follows=F.col("churn_predicted") == (score >= models.churn_threshold), has_segment=F.col("ml_segment").isNotNull(),
        in_range=F.greatest("propensity_bundle", "propensity_topup", "propensity_reactivation") <= 1,
        tier_follows=F.col("clv_tier") == rules.clv_tier(v, *(models.clv_thresholds[p] for p in (0.5, 0.75, 0.9))),
    )


@query("model_evaluation_check")
def _(s, d):
    found = evaluation.evaluate(_all_models(s, d), master(s, d))
    shares = [c for c in evaluation.METRICS if c not in ("mae", "rmse", "r2", "silhouette")]
    fits = [F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in shares]
    fits += [F.coalesce(F.col("r2") <= 1, F.lit(True)), F.coalesce(F.abs("silhouette") <= 1, F.lit(True))]
    fits += [F.coalesce(F.col("rmse") >= F.col("mae"), F.lit(True))]
    return found.select("model", "rows", reduce(lambda a, b: a & b, fits).alias("in_range"))


# the fitted churn model over two windows of the log


def _windows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _shared(s, d, "windows", lambda: monitoring.window_stores(_raw(s, d), rollup(s, d), WINDOW_DAYS))


def _run(s: SparkSession, d: str) -> monitoring.Run:
    model, _, names = _churn_model(s, d)
    return _shared(s, d, "monitor", lambda: monitoring.monitor(model, *_windows(s, d), names, timestamp=STAMP))


@query("window_feature_drift")
def _(s, d):
    reference, current = _windows(s, d)
    return drift.drift_report(reference, current, _features(current))


@query("model_prediction_drift")
def _(s, d):
    return _run(s, d).predictions


@query("model_performance")
def _(s, d):
    return _run(s, d).quality


@query("model_alerts")
def _(s, d):
    return _run(s, d).alerts


@query("model_monitoring_check")
def _(s, d):
    model, _, names = _churn_model(s, d)
    run, score = _run(s, d), F.col("churn_risk_score")
    rows = run.reference.withColumn("side", F.lit("reference")).unionByName(run.current.withColumn("side", F.lit("current")))
    again = churn.churn_probability(model, rows.drop("churn_risk_score")).select("customer_id", "side", F.col("churn_risk_score").alias("again"))
    reports = run.features.unionByName(run.predictions)
    off = (F.col("psi") > K.PSI_THRESHOLD) | (F.col("ks_p_value") < K.KS_ALPHA)
    reports = reports.agg(
        F.count(F.lit(1)).alias("reports"), F.count_if(F.col("drift_detected") == off).alias("flag_follows"),
        F.count_if(F.col("drift_detected") | (F.col("psi") > K.PSI_WATCH)).alias("raised"),
    ).first()
    aucs, told = run.quality.first(), run.alerts.where("alert_type != 'PERFORMANCE_DROP'").count()
    fell = aucs.reference_auc - aucs.current_auc >= K.AUC_DROP_WARNING
    found = rows.join(again, ["customer_id", "side"]).groupBy("side").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(score.between(0, 1)).alias("in_range"), F.count_if(score == F.col("again")).alias("same_again"),
        F.count_if("is_test").alias("held_out"),
    )
    return found.withColumns(
        {
            "reports": F.lit(reports.reports),
            "flag_follows": F.lit(reports.flag_follows),
            "alerts_follow": F.lit(reports.raised == told and fell == (run.alerts.count() > told)),
            "auc_in_range": F.lit(all(0 <= a <= 1 for a in (aucs.reference_auc, aucs.current_auc))),
        }
    )
