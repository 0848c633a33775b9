"""Independent SQL for the registered queries, run by another engine on the same tables."""

from __future__ import annotations

from subscope import constants as K
from subscope.plans.fixtures import (
    AMOUNT_COLUMNS, BATCH_FEATURES, BATCH_SCORES, DIGITS, PERFORMANCE, QUERY_CUSTOMER, STAMP, UNROUNDED, WINDOW_DAYS,
    ZCOLS,
)
from subscope.sources import adapters as A


def _rounded(body: str, columns: list[str], ctes: list[str]) -> str:
    """Wrap a query so that the named double and date columns look like the Spark side's."""
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    if not columns:
        return f"{head}{body}"
    parts = ", ".join(
        f"cast({c} AS string) AS {c}"
        if c.endswith("_date")
        else f"{c} + 0e0 AS {c}" if c in UNROUNDED else f"round({c} + 0.0, {DIGITS.get(c, 6)}) + 0e0 AS {c}"
        for c in columns
    )
    return f"{head}SELECT * REPLACE ({parts}) FROM ({body}) AS q"


def _cte(name: str, text: str) -> str:
    return f"{name} AS ({A.sql_text(text)})"


RAW = _cte("raw", A.PROFILES)
LOG = _cte("log", A.EVENT_LOG)
CLICKS = _cte("log", A.CLICK_LOG)
SCORES = _cte("scores", A.SCORES)
SUPPRESSED = _cte("suppressed", A.SUPPRESSION)


def _yn(c: str, also: str = "") -> str:
    return f"CASE WHEN {c} = 'Yes' THEN 1 WHEN {c} IN ('No'{also}) THEN 0 END AS {c}"


CLEAN_COLUMNS = [
    c for c in K.PROFILE_COLUMNS
    if c not in ("customerID", "SeniorCitizen", "TotalCharges", "tenure", "MonthlyCharges", *K.YES_NO_COLUMNS, *K.ADD_ON_COLUMNS)
]
PROF = (
    "prof AS (SELECT trim(customerID) AS customer_id, "
    "CASE SeniorCitizen WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS SeniorCitizen, "
    "tenure AS tenure_months, MonthlyCharges AS monthly_charges, "
    "try_cast(trim(TotalCharges) AS double) AS total_charges, "
    "CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn_label, "
    + ", ".join(_yn(c) for c in K.YES_NO_COLUMNS)
    + ", "
    + ", ".join(_yn(c, ", 'No internet service'") for c in K.ADD_ON_COLUMNS)
    + ", "
    + ", ".join(CLEAN_COLUMNS)
    + " FROM raw)"
)

OFFER = "(offer_presented IS NOT NULL AND offer_presented NOT IN ('', 'None'))"
TAKEN = "(coalesce(offer_accepted, '') IN ('True', 'true', '1'))"


def _exact_slope(y: str) -> str:
    """Slope over dated points from whole cents and days."""
    x, c = "cast(date_diff('day', DATE '1995-01-01', event_date) AS HUGEINT)", f"cast({y} * 100 AS HUGEINT)"
    ok = f"FILTER (WHERE {y} IS NOT NULL AND event_date IS NOT NULL)"
    n, sx, sy, sxy, sxx = (f"{a} {ok}" for a in ("count(*)", f"sum({x})", f"sum({c})", f"sum({x} * {c})", f"sum({x} * {x})"))
    return (
        f"CASE WHEN count(DISTINCT event_date) {ok} < 2 THEN 0e0 ELSE "
        f"cast({n} * {sxy} - {sx} * {sy} AS double) / 1e2 / cast({n} * {sxx} - {sx} * {sx} AS double) END"
    )


# the slope over 1..n, likewise
ORDINAL_SLOPE = (
    "CASE WHEN count(*) < 2 THEN 0e0 ELSE cast(count(*) * sum(2 * i * cast(recharge_amount * 100 AS HUGEINT)) "
    "- count(*) * (count(*) + 1) * sum(cast(recharge_amount * 100 AS HUGEINT)) AS double) / 1e2 * 6e0 "
    "/ cast(count(*) * count(*) * (count(*) * count(*) - 1) AS double) END"
)


def _features(short: int) -> list[str]:
    """The event feature block, written as separate aggregates and joins."""
    return [
        "ref AS (SELECT max(event_date) AS d FROM log)",
        f"acts AS (SELECT customer_id, count(DISTINCT event_date) AS active_days, max(event_date) AS last_day, "
        f"count(*) AS n, count(*) FILTER (WHERE channel = 'APP') AS n_app, "
        f"count(*) FILTER (WHERE {OFFER}) AS shown, count(*) FILTER (WHERE {TAKEN}) AS taken FROM log GROUP BY 1)",
        "chan AS (SELECT customer_id, channel FROM (SELECT customer_id, channel, "
        "row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, channel) AS rn "
        "FROM log WHERE channel IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)",
        "rech AS (SELECT customer_id, count(recharge_amount) AS n, sum(recharge_amount) AS s, "
        "avg(recharge_amount) AS a, max(event_date) AS last_day, "
        + _exact_slope("recharge_amount") + " AS slope "
        "FROM log WHERE event_type = 'RECHARGE' GROUP BY 1)",
        f"rech30 AS (SELECT customer_id, count(recharge_amount) AS n, sum(recharge_amount) AS s FROM log, ref "
        f"WHERE event_type = 'RECHARGE' AND event_date >= d - {short} GROUP BY 1)",
        "sess AS (SELECT customer_id, sum(data_mb_used) AS s, avg(data_mb_used) AS a FROM log "
        "WHERE event_type = 'DATA_SESSION' GROUP BY 1)",
        f"sess30 AS (SELECT customer_id, sum(data_mb_used) AS s FROM log, ref "
        f"WHERE event_type = 'DATA_SESSION' AND event_date >= d - {short} GROUP BY 1)",
        "days AS (SELECT customer_id, event_date, coalesce(sum(data_mb_used), 0) AS s FROM log "
        "WHERE event_type = 'DATA_SESSION' GROUP BY 1, 2)",
        f"dtrend AS (SELECT customer_id, {_exact_slope('s')} AS slope FROM days GROUP BY 1)",
        "feats AS (SELECT acts.customer_id, "
        "cast(coalesce(rech30.n, 0) AS int) AS recharge_count_30d, "
        "cast(coalesce(rech.n, 0) AS int) AS recharge_count_90d, "
        "coalesce(rech30.s, 0e0) AS total_recharge_30d, "
        "coalesce(rech.s, 0e0) AS total_recharge_90d, "
        "coalesce(rech.a, 0e0) AS avg_recharge_amount, "
        "cast(coalesce(date_diff('day', rech.last_day, ref.d), 90) AS int) AS days_since_last_recharge, "
        "coalesce(rech.slope, 0e0) AS recharge_trend, "
        "coalesce(sess30.s, 0e0) AS data_usage_mb_30d, "
        "coalesce(sess.s, 0e0) AS data_usage_mb_90d, "
        "coalesce(dtrend.slope, 0e0) AS data_usage_trend, "
        "coalesce(sess.a, 0e0) AS avg_session_mb, "
        "coalesce(chan.channel, 'USSD') AS preferred_channel, "
        "cast(n_app AS double) / acts.n AS app_usage_rate, "
        "cast(shown AS int) AS offers_presented, cast(taken AS int) AS offers_accepted, "
        "CASE WHEN shown = 0 THEN 0e0 ELSE cast(taken AS double) / shown END AS offer_acceptance_rate, "
        "cast(active_days AS int) AS active_days_90d, "
        "cast(date_diff('day', acts.last_day, ref.d) AS int) AS days_since_last_activity "
        "FROM acts CROSS JOIN ref LEFT JOIN chan USING (customer_id) LEFT JOIN rech USING (customer_id) "
        "LEFT JOIN rech30 USING (customer_id) LEFT JOIN sess USING (customer_id) "
        "LEFT JOIN sess30 USING (customer_id) LEFT JOIN dtrend USING (customer_id))",
    ]


FEATURE_DOUBLES = [
    "total_recharge_30d", "total_recharge_90d", "avg_recharge_amount", "recharge_trend",
    "data_usage_mb_30d", "data_usage_mb_90d", "data_usage_trend", "avg_session_mb",
    "app_usage_rate", "offer_acceptance_rate",
]
FLAG = "cast(coalesce({}, false) AS int) AS {}"
INDICATOR_SQL = [
    FLAG.format(f"lower({src}) = '{level}'", name)
    for src, spec in K.INDICATORS.items()
    for name, level in spec.items()
]
LINES_SQL = [
    FLAG.format(f"MultipleLines = '{v}'", f'"MultipleLines_{v}"') for v in ("No phone service", "Yes")
]
ZERO_FILLED = [c for c in K.EVENT_FEATURES if c not in ("customer_id", "preferred_channel")]
STORE = [
    RAW, PROF,
    "store AS (SELECT prof.customer_id, coalesce(SeniorCitizen, 'Unknown') AS SeniorCitizen, "
    "coalesce(tenure_months, 0) AS tenure_months, coalesce(monthly_charges, 0) AS monthly_charges, "
    "coalesce(total_charges, 0) AS total_charges, coalesce(churn_label, 0) AS churn_label, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*K.YES_NO_COLUMNS, *K.ADD_ON_COLUMNS, *ZERO_FILLED])
    + ", "
    + ", ".join([*INDICATOR_SQL, *LINES_SQL])
    + " FROM prof LEFT JOIN feats USING (customer_id))",
]
STORE_DOUBLES = ["monthly_charges", "total_charges", *FEATURE_DOUBLES]


def _bucket(value: str, q: int) -> str:
    """Bin of the first-come rank at interpolated quantiles, in integer arithmetic."""
    r = f"(row_number() OVER (ORDER BY {value}, customer_id) - 1)"
    n = "greatest(count(*) OVER () - 1, 1)"
    return f"cast(greatest(1, ({r} * {q} + {n} - 1) // {n}) AS int)"


RFM = (
    f"rfm AS (SELECT *, r_score * 100 + f_score * 10 + m_score AS rfm_score FROM (SELECT *, "
    f"6 - {_bucket('days_since_last_recharge', 5)} AS r_score, {_bucket('recharge_count_30d', 5)} AS f_score, "
    f"{_bucket('total_recharge_30d', 5)} AS m_score FROM store))"
)
SEGMENT = (
    "seg AS (SELECT *, CASE WHEN r_score = 5 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' "
    "WHEN r_score = 1 THEN 'Lost Customers' WHEN r_score = 5 AND f_score = 1 THEN 'New Customers' "
    "WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk' "
    "WHEN f_score >= 3 AND m_score >= 3 THEN 'Loyal Customers' "
    "WHEN r_score >= 4 AND f_score <= 3 THEN 'Potential Loyalists' ELSE 'Hibernating' END AS rfm_segment FROM rfm)"
)
ARPU_TIER = (
    f"CASE WHEN count(*) OVER () < 4 THEN 'Bronze' ELSE (['Bronze', 'Silver', 'Gold', 'Platinum'])"
    f"[{_bucket('total_recharge_90d / 3', 4)}] END AS arpu_tier"
)
ENGAGEMENT = (
    "active_days_90d / 9e1 * 4e-1 + app_usage_rate * 3e-1 + offer_acceptance_rate * 3e-1 AS engagement_score"
)
CHURN_FLAGS = (
    "CASE WHEN recharge_trend < -50 THEN 1 ELSE 0 END AS declining_recharge, "
    "CASE WHEN days_since_last_recharge > 14 THEN 1 ELSE 0 END AS long_silence, "
    "CASE WHEN active_days_90d < 20 THEN 1 ELSE 0 END AS low_activity, "
    "CASE WHEN recharge_count_30d < recharge_count_90d / 6e0 THEN 1 ELSE 0 END AS recharge_drop_flag"
)
BEHAVIOUR = [
    f"spend AS (SELECT *, total_recharge_90d / 3 AS arpu, {ARPU_TIER}, {ENGAGEMENT}, {CHURN_FLAGS} FROM seg)",
    "cuts AS (SELECT quantile_cont(data_usage_mb_30d, 0.75) AS d75, "
    "quantile_cont(cast(recharge_count_30d AS double), 0.5) AS c50, quantile_cont(arpu, 0.75) AS a75 FROM spend)",
    "beh AS (SELECT spend.*, CASE WHEN data_usage_mb_30d > d75 THEN 1 ELSE 0 END AS high_data_user, "
    "CASE WHEN recharge_count_30d > c50 THEN 1 ELSE 0 END AS frequent_recharger, "
    "CASE WHEN offer_acceptance_rate > 2e-1 THEN 1 ELSE 0 END AS high_offer_responder, "
    "CASE WHEN app_usage_rate > 3e-1 THEN 1 ELSE 0 END AS app_user, "
    "CASE WHEN arpu_tier IN ('Gold', 'Platinum') THEN 1 ELSE 0 END AS premium_customer, "
    "CASE WHEN tenure_months >= 12 AND arpu > a75 THEN 'High Value Loyal' "
    "WHEN tenure_months >= 3 AND days_since_last_recharge > 60 THEN 'Churned' "
    "WHEN tenure_months >= 3 AND days_since_last_recharge > 30 THEN 'Lapsing' "
    "WHEN tenure_months < 3 AND active_days_90d > 30 THEN 'New Active' "
    "WHEN tenure_months < 3 AND active_days_90d < 30 THEN 'New At-Risk' ELSE 'Active' END AS lifecycle_stage "
    "FROM spend, cuts)",
]
F2Y = [LOG, *_features(30)]
STORE2Y = [*F2Y, *STORE]
VALUE = [*STORE2Y, RFM, SEGMENT, *BEHAVIOUR]
MASTER = [*VALUE, SCORES, "master AS (SELECT * FROM beh JOIN scores USING (customer_id))"]
LISTS = [*MASTER, SUPPRESSED, "open_ AS (SELECT * FROM master WHERE customer_id NOT IN (SELECT customer_id FROM suppressed))"]
VALUE_DOUBLES = [*STORE_DOUBLES, "arpu", "engagement_score"]

RISK = "CASE WHEN churn_risk_score > 8e-1 THEN 'Critical' WHEN churn_risk_score > 65e-2 THEN 'High' WHEN churn_risk_score > 4e-1 THEN 'Medium' ELSE 'Low' END"


def _case(column: str, mapping: dict, default: str) -> str:
    def lit(v: object) -> str:
        return f"{v!r}" if isinstance(v, str) else f"cast({v} AS double)"

    arms = " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {default} END"


ACTION = _case(RISK, K.RISK_ACTIONS, "NULL")


def _rate(score: str) -> str:
    return f"CASE WHEN {score} > 8e-1 THEN 35e-2 WHEN {score} > 65e-2 THEN 2e-1 WHEN {score} > 5e-1 THEN 1e-1 ELSE 3e-2 END"


CHANNEL = (
    "CASE WHEN app_usage_rate > 3e-1 OR preferred_channel_app = 1 THEN 'PUSH_NOTIFICATION' "
    "WHEN preferred_channel_ussd = 1 THEN 'USSD' WHEN clv_tier IN ('Platinum', 'Gold') THEN 'OUTBOUND_CALL' ELSE 'SMS' END"
)
WEIGHT = _case("clv_tier", K.TIER_WEIGHT, "25e-2")
BUDGET = _case("clv_tier", K.TIER_BUDGET, "'Minimal'")

# name -> (eligibility, score, priority, offer, fixed channel)
LIST_RULES = {
    "churn_retention": (
        "churn_risk_score >= 65e-2", "churn_risk_score",
        f"churn_risk_score * 5e-1 + {WEIGHT} * 3e-1 + tenure_months / cast(max(tenure_months) OVER () AS double) * 2e-1",
        "CASE clv_tier WHEN 'Bronze' THEN 'Standard Retention SMS' WHEN 'Silver' THEN 'Loyalty Discount' ELSE 'Premium Retention Bundle' END",
        None,
    ),
    "bundle_upsell": (
        "propensity_bundle >= 5e-1 AND churn_risk_score < 5e-1", "propensity_bundle",
        f"propensity_bundle * 7e-1 + {WEIGHT} * 3e-1",
        "CASE WHEN data_usage_mb_30d < quantile_cont(data_usage_mb_30d, 0.5) OVER () THEN '1GB Daily Bundle' ELSE '5GB Monthly Bundle' END",
        None,
    ),
    "voice_topup": (
        "propensity_topup >= 5e-1 AND churn_risk_score < 5e-1", "propensity_topup",
        f"propensity_topup * 7e-1 + {WEIGHT} * 3e-1",
        "'Voice Top-up: Get ₦100 bonus on ₦500 recharge'",
        None,
    ),
    "reactivation": (
        "days_since_last_recharge > 20 AND propensity_reactivation >= 5e-1 AND total_recharge_90d > "
        "(SELECT quantile_cont(total_recharge_90d, 0.2) FROM master)",
        "propensity_reactivation",
        "propensity_reactivation * 6e-1 + total_recharge_90d / (max(total_recharge_90d) OVER ()) * 4e-1",
        "'Welcome Back: 2x data for 7 days'",
        "'USSD'",
    ),
    "loyalty_reward": (
        "rfm_segment IN ('Champions', 'Loyal Customers') AND churn_risk_score < 3e-1",
        "clv_90d / (max(clv_90d) OVER ())", "clv_90d / (max(clv_90d) OVER ())",
        "CASE WHEN clv_tier IN ('Platinum', 'Gold') THEN 'Exclusive Bundle Discount' ELSE 'Loyalty Points Bonus' END",
        None,
    ),
}


def _list_sql(kind: str, size: int) -> str:
    ok, score, priority, offer, channel = LIST_RULES[kind]
    return (
        f"SELECT customer_id, '{kind}' AS campaign_name, 'Standard' AS segment_label, rfm_segment, churn_risk_score, "
        f"propensity_score, clv_tier, {offer} AS recommended_offer, {channel or CHANNEL} AS recommended_channel, "
        f"priority_score, {_rate('propensity_score')} AS estimated_response_rate, {BUDGET} AS retention_budget "
        f"FROM (SELECT *, {score} AS propensity_score, {priority} AS priority_score FROM open_ WHERE {ok} "
        f"ORDER BY priority_score DESC, customer_id LIMIT {size}) AS l"
    )


ALL_LISTS = " UNION ALL ".join(f"SELECT * FROM ({_list_sql(k, 5000)})" for k in K.CAMPAIGNS)
LIST_DOUBLES = ["churn_risk_score", "propensity_score", "priority_score"]

def _unpivot(table: str, features: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{f.strip('"')}' AS feature_name, cast({f} AS double) AS value FROM {table}""" for f in features
    )


def _drift(features: list[str]) -> list[str]:
    edges = " + ".join(f"cast(value >= lo + {k}e0 * (hi - lo) / 10e0 AS int)" for k in range(1, 10))
    series = " ".join(
        f"{'+' if k % 2 else '-'} 2e0 * exp({-2 * k * k}e0 * lam * lam)" for k in range(1, 51)
    )
    ratios = " ".join(f"{'+' if k % 2 else '-'} exp({-2 * (k * k - 1)}e0 * lam * lam)" for k in range(2, 51))
    return [
        f"lr AS ({_unpivot('prev', features)})",
        f"lc AS ({_unpivot('cur', features)})",
        "sr AS (SELECT feature_name, count(value) AS n_ref, avg(value) AS reference_mean, min(value) AS lo, max(value) AS hi FROM lr GROUP BY 1)",
        "sc AS (SELECT feature_name, count(value) AS n_cur, avg(value) AS current_mean FROM lc GROUP BY 1)",
        f"br AS (SELECT feature_name, {edges} AS b, count(*) AS n FROM lr JOIN sr USING (feature_name) GROUP BY 1, 2)",
        f"bc AS (SELECT feature_name, {edges} AS b, count(*) AS n FROM lc JOIN sr USING (feature_name) GROUP BY 1, 2)",
        "grid AS (SELECT feature_name, lo, hi, (coalesce(br.n, 0) / cast(n_ref AS double) + 1e-4) / 1001e-3 AS e, "
        "(coalesce(bc.n, 0) / cast(n_cur AS double) + 1e-4) / 1001e-3 AS a "
        "FROM sr JOIN sc USING (feature_name) CROSS JOIN (SELECT unnest(range(10)) AS b) AS bins "
        "LEFT JOIN br USING (feature_name, b) LEFT JOIN bc USING (feature_name, b))",
        "psi AS (SELECT feature_name, sum(CASE WHEN lo = hi THEN 0e0 ELSE (a - e) * ln(a / e) END) AS psi FROM grid GROUP BY 1)",
        "both_ AS (SELECT feature_name, value, 1 AS r, 0 AS c FROM lr UNION ALL SELECT feature_name, value, 0, 1 FROM lc)",
        "ecdf AS (SELECT feature_name, sum(sum(r)) OVER w AS r, sum(sum(c)) OVER w AS c FROM both_ GROUP BY feature_name, value "
        "WINDOW w AS (PARTITION BY feature_name ORDER BY value))",
        "ks AS (SELECT feature_name, max(abs(cast(r AS double) / n_ref - cast(c AS double) / n_cur)) AS ks_statistic, "
        "any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur FROM ecdf JOIN sr USING (feature_name) JOIN sc USING (feature_name) GROUP BY 1)",
        f"pv AS (SELECT feature_name, ks_statistic, n_ref, n_cur, CASE WHEN lam < 2e-1 THEN 1e0 ELSE least(1e0, greatest(0e0, 0e0 {series})) END AS ks_p_value, "
        f"CASE WHEN lam < 2e-1 THEN 0e0 WHEN lam < 1e0 THEN log10(0e0 {series}) ELSE (ln(2e0) - 2e0 * lam * lam + ln(1e0 {ratios})) / ln(1e1) END AS ks_log10_p_value "
        "FROM (SELECT *, sqrt(cast(n_ref AS double) * n_cur / (n_ref + n_cur)) * ks_statistic AS lam FROM ks))",
        "report AS (SELECT feature_name, psi, ks_statistic, ks_p_value, psi > 2e-1 OR ks_p_value < 5e-2 AS drift_detected, "
        "CASE WHEN psi >= 2e-1 THEN 'severe' WHEN psi >= 1e-1 THEN 'moderate' ELSE 'none' END AS severity, "
        "reference_mean, current_mean, (current_mean - reference_mean) / (reference_mean + 1e-9) AS mean_shift_pct "
        "FROM psi JOIN pv USING (feature_name) JOIN sr USING (feature_name) JOIN sc USING (feature_name))",
    ]


def _window(earlier: bool) -> list[str]:
    """The log of one window, and the event features over it."""
    last = "(SELECT max(event_date) FROM {})"
    cut = f"WHERE event_date < {last.format('whole')} - {WINDOW_DAYS}" if earlier else ""
    log = f"log AS (SELECT * FROM upto WHERE event_date >= {last.format('upto')} - {WINDOW_DAYS})"
    return [_cte("whole", A.EVENT_LOG), f"upto AS (SELECT * FROM whole {cut})", log, *_features(30)]


def _batch(name: str, earlier: bool) -> str:
    """Features, scores and label of one window of the log, with all that leads to them inside."""
    steps = [*_window(earlier), RAW, PROF]
    scores = ", ".join(f"{score} AS {c}" for c, score in BATCH_SCORES.items())
    return f"{name} AS (WITH {', '.join(steps)} SELECT *, {scores} FROM feats JOIN (SELECT customer_id, churn_label FROM prof) AS p USING (customer_id))"


def _window_store(name: str, earlier: bool) -> str:
    """The value store as a rebuild on the last day of a window gives it."""
    return f"{name} AS (WITH {', '.join([*_window(earlier), *STORE, RFM, SEGMENT, *BEHAVIOUR])} SELECT * FROM beh)"


BATCHES = [_batch("prev", True), _batch("cur", False)]
DRIFT = [*BATCHES, *_drift(BATCH_FEATURES)]
SCORE_DRIFT = [*BATCHES, *_drift(["churn_risk_score"])]
REPORT_DOUBLES = ["psi", "ks_statistic", "ks_p_value", "reference_mean", "current_mean", "mean_shift_pct"]


def _alert(kind: str, source: str, critical: str, subject: str, value: str, threshold: str, message: str, action: str) -> str:
    return (
        f"SELECT md5(concat('{kind}|', {subject}, '|{STAMP}')) AS alert_id, '{kind}' AS alert_type, "
        f"CASE WHEN {critical} THEN 'CRITICAL' ELSE 'WARNING' END AS severity, {subject} AS feature_name, "
        f"{value} AS metric_value, {threshold} AS threshold, {message} AS message, {action} AS recommended_action, "
        f"'{STAMP}' AS timestamp FROM {source}"
    )


RAISED = "report WHERE drift_detected OR psi > 1e-1"
FEATURE_ALERTS = _alert(
    "DATA_DRIFT", RAISED, "psi >= 2e-1", "feature_name", "psi", "2e-1",
    "printf('Feature ''%s'' has drifted. PSI = %.4f (KS p-val = %.4f)', feature_name, psi, ks_p_value)",
    f"CASE WHEN psi >= 2e-1 THEN '{K.ALERT_ACTIONS['retrain']}' ELSE '{K.ALERT_ACTIONS['watch']}' END",
)
PREDICTION_ALERTS = _alert(
    "PREDICTION_DRIFT", RAISED, "psi >= 2e-1", "'churn_risk_score'", "psi", "2e-1",
    "printf('Prediction score distribution has shifted. PSI = %.4f (KS p-val = %.4f)', psi, ks_p_value)",
    f"'{K.ALERT_ACTIONS['prediction']}'",
)
PERF_ALERTS = _alert(
    "PERFORMANCE_DROP", "auc WHERE reference_auc - current_auc >= 2e-2", "reference_auc - current_auc >= 5e-2",
    "model_name", "reference_auc - current_auc", "5e-2",
    "printf('Model performance drop detected on %s. Current AUC: %.4f (Ref: %.4f, drop: %.2f%%)', model_name, current_auc, reference_auc, (reference_auc - current_auc) * 1e2)",
    f"'{K.ALERT_ACTIONS['performance']}'",
)
AUC_SQL = (
    "SELECT sum(p * (below + n / 2e0)) / (sum(p) * sum(n)) AS auc_roc FROM (SELECT p, n, "
    "sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below "
    "FROM (SELECT {score} AS s, cast(sum(churn_label) AS double) AS p, cast(sum(1 - churn_label) AS double) AS n FROM {table} GROUP BY 1))"
)
PERF = [
    *BATCHES,
    "auc AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS model_name, (SELECT auc_roc FROM ({AUC_SQL.format(score=s, table='prev')})) AS reference_auc, "
        f"(SELECT auc_roc FROM ({AUC_SQL.format(score=s, table='cur')})) AS current_auc"
        for s, m in PERFORMANCE.items()
    ) + ")",
]


SPLIT = "md5(concat(customer_id, ':42'))"

ZSTATS = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(ZCOLS))
Z = [
    *MASTER,
    f"zst AS (SELECT {ZSTATS} FROM master)",
    "z AS (SELECT customer_id, cluster, "
    + ", ".join(f"CASE WHEN s{i} = 0 THEN 0e0 ELSE ({c} - m{i}) / s{i} END AS {c}_z" for i, c in enumerate(ZCOLS))
    + " FROM master, zst)",
]


def _soft() -> str:
    dist = " + ".join(f"(z.{c}_z - c.{c}_z) * (z.{c}_z - c.{c}_z)" for c in ZCOLS)
    means = ", ".join(f"avg({c}_z) AS {c}_z" for c in ZCOLS)
    pick = ", ".join(f"sum(CASE WHEN k = {i} THEN w END) / sum(w) AS weight_{i}" for i in range(6))
    return (
        f"SELECT customer_id, {pick} FROM (SELECT z.customer_id, c.cluster AS k, 1e0 / (sqrt({dist}) + 1e-5) AS w "
        f"FROM z CROSS JOIN (SELECT cluster, {means} FROM z GROUP BY 1) AS c) GROUP BY 1"
    )


def _silhouette() -> str:
    """Mean silhouette with squared distances, from the size, sum and squared norm of each cluster."""
    norm = " + ".join(f"{c}_z * {c}_z" for c in ZCOLS)
    sums = ", ".join(f"sum({c}_z) AS y{i}" for i, c in enumerate(ZCOLS))
    dot = " + ".join(f"{c}_z * y{i}" for i, c in enumerate(ZCOLS))
    return (
        "SELECT avg(CASE WHEN n = 1 THEN 0e0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (SELECT customer_id, "
        "max(CASE WHEN own THEN nc END) AS n, max(CASE WHEN own AND nc > 1 THEN (nc * sq + psi - 2 * dot) / (nc - 1) END) AS a, "
        "min(CASE WHEN NOT own THEN sq + psi / nc - 2 * dot / nc END) AS b FROM (SELECT customer_id, z.cluster = c.cluster AS own, "
        f"nc, psi, {norm} AS sq, {dot} AS dot FROM z CROSS JOIN (SELECT cluster, count(*) AS nc, sum({norm}) AS psi, {sums} FROM z GROUP BY 1) AS c) GROUP BY 1)"
    )


def _components(rounds: int = 1500) -> str:
    """Scores on the first two eigenvectors of the correlations, found by repeated multiplication, the largest loading positive."""
    n = len(MATRIX)
    z = ", ".join(f"CASE WHEN s{i} > 0 THEN (cast({c} AS double) - m{i}) / s{i} ELSE 0e0 END" for i, c in enumerate(MATRIX))
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(MATRIX))

    def power(name: str, matrix: str) -> str:
        return (
            f"{name} AS (SELECT 0 AS k, [1e0 + i / 7e0 FOR i IN range({n})] AS v UNION ALL "
            "SELECT k + 1, list_transform(w, lambda x: x / size) FROM (SELECT k, w, sqrt(list_inner_product(w, w)) AS size FROM "
            f"(SELECT k, list_transform(m, lambda r: list_inner_product(r, v)) AS w FROM {name}, {matrix} WHERE k < {rounds}))), "
            f"{name}_end AS (SELECT list_transform(v, lambda x: x * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END) AS v FROM {name} WHERE k = {rounds})"
        )

    return (
        f"WITH RECURSIVE zs AS (SELECT {stats} FROM master), zm AS (SELECT customer_id, [{z}] AS x FROM master, zs), "
        f"ij AS (SELECT a.i, b.i AS j FROM (SELECT unnest(range(1, {n + 1})) AS i) AS a, (SELECT unnest(range(1, {n + 1})) AS i) AS b), "
        "cov AS (SELECT i, j, sum(x[i] * x[j]) / (count(*) - 1) AS c FROM zm, ij GROUP BY 1, 2), "
        "mat AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY 1)), "
        f"{power('first', 'mat')}, "
        "value AS (SELECT v, m, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS l FROM first_end, mat), "
        f"rest AS (SELECT [[m[i][j] - l * v[i] * v[j] FOR j IN range(1, {n + 1})] FOR i IN range(1, {n + 1})] AS m FROM value), "
        f"{power('second', 'rest')} "
        "SELECT customer_id, list_inner_product(x, a.v) AS pc1, list_inner_product(x, b.v) AS pc2 FROM zm, first_end AS a, second_end AS b"
    )


# counts of customers for whom a rule holds, and what else must be true of a fitted model
MODEL_RULES = {
    "model_roundtrip_check": {"unchanged": "count(*)"},
    "churn_model_check": dict.fromkeys(["in_range", "flag_follows", "tier_follows", "action_follows"], "count(*)")
    | dict.fromkeys(["no_better_round", "patience_kept"], "true"),
    "churn_attribution_check": {"adds_up": "count(*)"},
    "kmeans_segments_check": {"at_nearest": "count(*)", "clusters": "6", "labels": "6"},
    "clv_scores_check": dict.fromkeys(["not_negative", "tier_follows", "budget_follows", "month_follows"], "count(*)"),
    "score_all_models_check": dict.fromkeys(["same_alone", "flag_follows", "has_segment", "in_range", "tier_follows"], "count(*)"),
}


MATRIX = [
    c
    for c in ["tenure_months", "monthly_charges", "total_charges", *K.YES_NO_COLUMNS, *K.ADD_ON_COLUMNS, *ZERO_FILLED]
] + [n for spec in K.INDICATORS.values() for n in spec] + [
    '"MultipleLines_No phone service"', '"MultipleLines_Yes"', "r_score", "f_score", "m_score", "rfm_score", "arpu",
    "engagement_score", "declining_recharge", "long_silence", "low_activity", "recharge_drop_flag", "high_data_user",
    "frequent_recharger", "high_offer_responder", "app_user", "premium_customer",
]
CLUSTERS = [
    *MASTER,
    "prof_ AS (SELECT cluster, "
    + ", ".join(f"avg({c}) AS {c}" for c in K.CLUSTER_METRICS)
    + ", count(*) AS count FROM master GROUP BY 1)",
]


def _labels() -> tuple[list[str], str]:
    """Greedy roles: each picks the largest value among the clusters still free."""
    order = [("dormant", "days_since_last_recharge"), ("high_value", "arpu"), ("at_risk", "churn_risk_score"),
             ("loyal", "tenure_months"), ("price", "recharge_count_30d")]
    ctes, taken = list(CLUSTERS), []
    for role, metric in order:
        free = f"WHERE cluster NOT IN ({', '.join(f'(SELECT cluster FROM r_{t})' for t in taken)})" if taken else ""
        ctes.append(f"r_{role} AS (SELECT cluster FROM prof_ {free} ORDER BY {metric} DESC, cluster LIMIT 1)")
        taken.append(role)
    rest = " AND ".join(f"cluster NOT IN (SELECT cluster FROM r_{t})" for t in taken)
    ctes.append(f"r_rising AS (SELECT cluster FROM prof_ WHERE {rest})")
    rows = []
    for role in [*taken, "rising"]:
        label, text, campaign = (x.replace("'", "''") for x in K.SEGMENT_TEXTS[role])
        rows.append(
            f"SELECT cluster, '{label}' AS segment_label, '{text}' AS description, '{campaign}' AS recommended_campaign FROM r_{role}"
        )
    return ctes, " UNION ALL ".join(rows)


LABEL_CTES, LABEL_SQL = _labels()
GRID = "(SELECT unnest(range(11)) AS i)"


def _hist(column: str, n: int) -> str:
    edges = " + ".join(f"cast({column} >= lo + {k}e0 * (hi - lo) / {n}e0 AS int)" for k in range(1, n))
    return (
        f"SELECT cast(i AS int) AS bin, lo + i * (hi - lo) / {n}e0 AS bin_start, coalesce(n, 0) AS n "
        f"FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM master) CROSS JOIN (SELECT unnest(range({n})) AS i) "
        f"LEFT JOIN (SELECT {edges} AS i, count(*) AS n FROM master, (SELECT min({column}) AS lo, max({column}) AS hi FROM master) GROUP BY 1) USING (i)"
    )


SUMMARY = " UNION ALL ".join(
    f"SELECT '{k}' AS campaign, count(*) AS eligible_customers, coalesce(avg(propensity_score), 0e0) AS avg_propensity_score, "
    f"coalesce(avg({_case('clv_tier', K.TIER_INDEX, 'NULL')}), 0e0) AS avg_clv_tier_index "
    f"FROM (SELECT *, {LIST_RULES[k][1]} AS propensity_score FROM open_ WHERE {LIST_RULES[k][0]})"
    for k in K.CAMPAIGNS
)

CONTRIB = " UNION ALL ".join(
    f"SELECT customer_id, '{c}' AS feature, {c}_z AS contribution FROM z" for c in ZCOLS
)


def build() -> dict[str, str]:
    r = _rounded
    profile_cols = ", ".join(c for c in K.PROFILE_COLUMNS)
    out = {
        "scan_profiles": r(f"SELECT {profile_cols} FROM raw", ["MonthlyCharges"], [RAW]),
        "scan_events": r(f"SELECT {', '.join(K.EVENT_COLUMNS)} FROM log", ["event_date", "recharge_amount", "data_mb_used"], [LOG]),
        "schema_contract": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, true AS present, count({c}) AS filled_rows FROM raw" for c in K.PROFILE_COLUMNS
        ),
        "coerce_types": r(
            "SELECT row_id, try_cast(event_date AS date) AS event_date, try_cast(amount AS double) AS amount FROM txt",
            ["event_date"], [_cte("txt", A.RAW_TEXT)],
        ),
        "clean_keys_and_labels": r(
            "SELECT trim(customerID) AS customerID, CASE SeniorCitizen WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS SeniorCitizen, "
            "try_cast(trim(TotalCharges) AS double) AS TotalCharges, CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn_label FROM raw",
            [], [RAW],
        ),
        "value_distribution": r("SELECT event_type AS value, count(*) AS n FROM log GROUP BY 1", [], [CLICKS]),
        "key_integrity": r(
            "SELECT customer_id, 'profiles' AS only_in FROM prof WHERE customer_id NOT IN (SELECT customer_id FROM log) "
            "UNION ALL SELECT DISTINCT customer_id, 'events' FROM log WHERE customer_id NOT IN (SELECT customer_id FROM prof)",
            [], [RAW, LOG, PROF],
        ),
        "rfm_export": r("SELECT customer_id, rfm_score FROM rfm", [], [*STORE2Y, RFM]),
        "normalize_profile": r(
            "SELECT customer_id, tenure_months, monthly_charges, total_charges, churn_label, "
            + ", ".join(f"cast({c} AS double) AS {c}" for c in [*K.YES_NO_COLUMNS, *K.ADD_ON_COLUMNS]) + " FROM prof", ["monthly_charges"], [RAW, PROF],
        ),
        "one_hot_fixed": r(
            "SELECT prof.customer_id, " + ", ".join(INDICATOR_SQL) + " FROM prof LEFT JOIN (SELECT customer_id, channel AS preferred_channel FROM chan) USING (customer_id)",
            [], [RAW, LOG, PROF, *_features(30)],
        ),
        "one_hot_dynamic": r("SELECT customer_id, " + ", ".join(LINES_SQL) + " FROM prof", [], [RAW, PROF]),
        "fill_missing": r(
            "SELECT customer_id, coalesce(total_charges, 0) AS total_charges, coalesce(Dependents, 0) AS Dependents, "
            "coalesce(StreamingMovies, 0) AS StreamingMovies, coalesce(channel, 'Unknown') AS preferred_channel "
            "FROM prof LEFT JOIN chan USING (customer_id)",
            [], [RAW, LOG, PROF, *_features(30)],
        ),
        "fill_defaults": r(
            "SELECT prof.customer_id, " + ", ".join(
                f"coalesce({c}, {d!r}) AS {c}" if not isinstance(d, float) else f"coalesce({c}, 0e0) AS {c}"
                for c, d in K.EVENT_DEFAULTS.items()
            ) + " FROM prof LEFT JOIN feats USING (customer_id)",
            FEATURE_DOUBLES, [RAW, LOG, PROF, *_features(30)],
        ),
        "event_filters": r(
            "SELECT customer_id, event_date, recharge_amount FROM log, (SELECT max(event_date) AS d FROM log) WHERE event_type = 'RECHARGE' AND event_date >= d - 30",
            ["event_date", "recharge_amount"], [LOG],
        ),
        "offer_flags": r(
            f"SELECT customer_id, event_date, event_type, {OFFER} AS has_offer, {TAKEN} AS is_accepted FROM log", ["event_date"], [CLICKS],
        ),
        "arpu": r("SELECT customer_id, total_recharge_90d / 3 AS arpu FROM store", ["arpu"], STORE2Y),
        "engagement_score": r(f"SELECT customer_id, {ENGAGEMENT} FROM store", ["engagement_score"], STORE2Y),
        "churn_signals": r(f"SELECT customer_id, {CHURN_FLAGS} FROM store", [], STORE2Y),
        "upsell_signals": r(
            "SELECT customer_id, high_data_user, frequent_recharger, high_offer_responder, app_user, premium_customer FROM beh", [], VALUE),
        "lifecycle_stage": r("SELECT customer_id, lifecycle_stage FROM beh", [], VALUE),
        "risk_tier_action": r(
            f"SELECT customer_id, churn_risk_score, {RISK} AS risk_tier, {ACTION} AS recommended_action FROM scores", ["churn_risk_score"], [SCORES]),
        "response_rate": r(
            f"SELECT customer_id, {_rate('propensity_bundle')} AS estimated_response_rate FROM scores", [], [SCORES]),
        "recommend_channel": r(f"SELECT customer_id, {CHANNEL} AS recommended_channel FROM master", [], MASTER),
        "clv_tier_budget": r(
            "SELECT customer_id, clv_90d, clv_tier, " + _case("clv_tier", K.TIER_BUDGET, "'Minimal'") + " AS retention_budget_tier, clv_90d / 3e0 AS monthly_arpu_estimate "
            "FROM (SELECT customer_id, clv_90d, CASE WHEN clv_90d > p90 THEN 'Platinum' WHEN clv_90d > p75 THEN 'Gold' WHEN clv_90d > p50 THEN 'Silver' ELSE 'Bronze' END AS clv_tier "
            "FROM (SELECT customer_id, clv_90d * 5e1 AS clv_90d FROM master), (SELECT quantile_cont(total_recharge_90d, 0.5) AS p50, quantile_cont(total_recharge_90d, 0.75) AS p75, quantile_cont(total_recharge_90d, 0.9) AS p90 FROM master))",
            ["clv_90d", "monthly_arpu_estimate"], MASTER),
        "clv_target": r(
            "SELECT customer_id, ln(1 + total_recharge_90d * (1 - churn_label * 8e-1)) AS clv_log_target, "
            "greatest(total_recharge_90d * (1 - churn_label * 8e-1), 0e0) AS clv_back FROM master",
            ["clv_log_target", "clv_back"], MASTER),
        "customer_profile": r(
            f"SELECT customer_id, tenure_months, churn_risk_score, churn_risk_score >= 5e-1 AS churn_predicted, {RISK} AS risk_tier, clv_90d, clv_tier, rfm_segment, "
            f"'Dormant' AS ml_segment, propensity_bundle, propensity_topup, propensity_reactivation, lifecycle_stage FROM master WHERE customer_id = '{QUERY_CUSTOMER}'",
            ["churn_risk_score", "clv_90d", "propensity_bundle", "propensity_topup", "propensity_reactivation"], MASTER),
        "profile_left_join": r(
            "SELECT prof.customer_id, tenure_months, monthly_charges, cast(recharge_count_90d AS double) AS recharge_count_90d, total_recharge_90d, preferred_channel FROM prof LEFT JOIN feats USING (customer_id)",
            ["monthly_charges", "total_recharge_90d"], [RAW, LOG, PROF, *_features(30)]),
        "feature_block_joins": r(
            "SELECT acts.customer_id, acts.n AS total_events_count, active_days AS active_days_90d, cast(rech.n AS double) AS recharge_count, rech.s AS total_recharge, chan.channel AS preferred_channel "
            "FROM acts LEFT JOIN rech USING (customer_id) LEFT JOIN chan USING (customer_id)",
            ["total_recharge"], [LOG, *_features(30)]),
        "customers_without_events": r(
            "SELECT customer_id, tenure_months FROM prof WHERE customer_id NOT IN (SELECT customer_id FROM log)", [], [RAW, LOG, PROF]),
        "suppression_anti_join": r("SELECT customer_id, churn_risk_score FROM scores WHERE customer_id NOT IN (SELECT customer_id FROM suppressed)", ["churn_risk_score"], [SCORES, SUPPRESSED]),
        "dictionary_lookup": r(f"SELECT customer_id, clv_tier, {WEIGHT} AS tier_weight, {BUDGET} AS retention_budget FROM scores", [], [SCORES]),
        "activity_agg": r(
            "SELECT acts.customer_id, active_days AS active_days_90d, last_day AS last_activity_date, n AS total_events_count, cast(date_diff('day', last_day, d) AS int) AS days_since_last_activity FROM acts, ref",
            ["last_activity_date"], [LOG, *_features(30)]),
        "recharge_agg_90d": r(
            "SELECT customer_id, n AS recharge_count, s AS total_recharge, a AS avg_recharge_amount, last_day AS last_recharge_date, cast(date_diff('day', last_day, d) AS int) AS days_since_last_recharge FROM rech, ref",
            ["total_recharge", "avg_recharge_amount", "last_recharge_date"], [LOG, *_features(30)]),
        "recharge_agg_30d": r(
            "SELECT customer_id, n AS recharge_count_30d, s AS total_recharge_30d FROM rech30", ["total_recharge_30d"], [LOG, *_features(30)]),
        "data_usage_agg": r(
            "SELECT sess.customer_id, sess.s AS data_usage_mb_90d, sess.a AS avg_session_mb, coalesce(sess30.s, 0e0) AS data_usage_mb_30d FROM sess LEFT JOIN sess30 USING (customer_id)",
            ["data_usage_mb_90d", "avg_session_mb", "data_usage_mb_30d"], [LOG, *_features(30)]),
        "offer_acceptance_rate": r(
            "SELECT customer_id, shown AS offers_presented, taken AS offers_accepted, CASE WHEN shown = 0 THEN 0e0 ELSE cast(taken AS double) / shown END AS offer_acceptance_rate FROM acts",
            ["offer_acceptance_rate"], [CLICKS, *_features(10)]),
        "app_usage_rate": r("SELECT customer_id, cast(n_app AS double) / n AS app_usage_rate FROM acts", ["app_usage_rate"], [LOG, *_features(30)]),
        "preferred_channel": r("SELECT customer_id, channel AS preferred_channel FROM chan", [], [CLICKS, *_features(10)]),
        "recharge_trend": r("SELECT customer_id, slope AS recharge_trend FROM rech", ["recharge_trend"], [LOG, *_features(30)]),
        "data_usage_trend": r("SELECT customer_id, slope AS data_usage_trend FROM dtrend", ["data_usage_trend"], [LOG, *_features(30)]),
        "recharge_trend_ordinal": r(
            f"SELECT customer_id, {ORDINAL_SLOPE} AS recharge_trend FROM "
            "(SELECT customer_id, recharge_amount, row_number() OVER (PARTITION BY customer_id ORDER BY event_date, recharge_amount) AS i FROM log WHERE event_type = 'RECHARGE') GROUP BY 1",
            ["recharge_trend"], [LOG]),
        "reference_dates": r("SELECT min(event_date) AS min_date, max(event_date) AS max_date FROM log", ["min_date", "max_date"], [LOG]),
        "feature_quantiles": r(
            " UNION ALL ".join(
                f"SELECT '{c}' AS feature_name, " + ", ".join(f"quantile_cont(cast({c} AS double), {p}) AS p{round(p * 100)}" for p in (0.2, 0.25, 0.5, 0.75, 0.9)) + " FROM master"
                for c in AMOUNT_COLUMNS), ["p20", "p25", "p50", "p75", "p90"], MASTER),
        "rfm_segment_profiles": r(
            "SELECT rfm_segment, avg(days_since_last_recharge) AS avg_days_since_last_recharge, avg(recharge_count_30d) AS avg_recharge_count_30d, avg(total_recharge_30d) AS avg_total_recharge_30d, avg(monthly_charges) AS avg_monthly_charges FROM master GROUP BY 1",
            ["avg_days_since_last_recharge", "avg_recharge_count_30d", "avg_total_recharge_30d", "avg_monthly_charges"], MASTER),
        "cluster_profiles": r("SELECT * FROM prof_", list(K.CLUSTER_METRICS), CLUSTERS),
        "clv_tier_summary": r(
            "SELECT t.clv_tier, count(m.customer_id) AS customers, coalesce(avg(m.clv_90d), 0e0) AS mean_clv, count(m.customer_id) * 1e2 / (SELECT count(*) FROM master) AS percent "
            "FROM (SELECT unnest(['Platinum', 'Gold', 'Silver', 'Bronze']) AS clv_tier) AS t LEFT JOIN master AS m USING (clv_tier) GROUP BY 1",
            ["mean_clv", "percent"], MASTER),
        "segment_counts": r("SELECT rfm_segment AS segment, count(*) AS customers FROM master GROUP BY 1", [], MASTER),
        "lifecycle_funnel": r(
            "SELECT cast(i AS int) AS position, s.lifecycle_stage, count(m.customer_id) AS customers FROM (SELECT unnest(range(5)) AS i, unnest("
            + str(K.FUNNEL_STAGES) + ") AS lifecycle_stage) AS s LEFT JOIN master AS m USING (lifecycle_stage) GROUP BY 1, 2", [], MASTER),
        "rfm_heatmap": r(
            "SELECT cast(r AS int) AS r_score, cast(f AS int) AS f_score, coalesce(avg(monthly_charges), 0e0) AS avg_monthly_charges FROM (SELECT unnest(range(1, 6)) AS r) CROSS JOIN (SELECT unnest(range(1, 6)) AS f) "
            "LEFT JOIN master AS m ON m.r_score = r AND m.f_score = f GROUP BY 1, 2", ["avg_monthly_charges"], MASTER),
        "score_histogram": r(
            " UNION ALL ".join(f"SELECT '{c}' AS score, * FROM ({_hist(c, n)})" for c, n in
                               [("churn_risk_score", 20), ("propensity_bundle", 15), ("propensity_topup", 15), ("propensity_reactivation", 15)]),
            ["bin_start"], MASTER),
        "kpi_summary": r(
            "SELECT count(*) AS total_customers, count(*) FILTER (WHERE churn_risk_score >= 65e-2) AS at_risk_customers, avg(arpu) AS avg_arpu, "
            "count(*) FILTER (WHERE clv_tier = 'Platinum') * 1e2 / count(*) AS platinum_percent, "
            f"(SELECT cast(sum(eligible_customers) AS bigint) FROM ({SUMMARY})) AS campaign_eligible FROM master",
            ["avg_arpu", "platinum_percent"], LISTS),
        "score_summary": r(
            "SELECT 'all' AS section, 'customers' AS name, count(*) AS customers, cast(NULL AS double) AS mean FROM master "
            "UNION ALL SELECT 'churn_risk', 'Critical', count(*), NULL FROM master WHERE churn_risk_score > 8e-1 "
            "UNION ALL SELECT 'churn_risk', 'High', count(*), NULL FROM master WHERE churn_risk_score > 65e-2 AND churn_risk_score <= 8e-1 "
            "UNION ALL SELECT 'segment', rfm_segment, count(*), NULL FROM master GROUP BY 2 "
            f"UNION ALL SELECT 'clv_tier', t, count(clv_tier), NULL FROM (SELECT unnest({K.TIERS}) AS t) LEFT JOIN master ON clv_tier = t GROUP BY 2 "
            + " ".join(f"UNION ALL SELECT 'propensity', '{c}', count({c}), avg({c}) FROM master" for c in
                       ("propensity_bundle", "propensity_topup", "propensity_reactivation")),
            ["mean"], MASTER),
        "campaign_summary": r(SUMMARY, ["avg_propensity_score", "avg_clv_tier_index"], LISTS),
        "channel_reach": r(
            f"SELECT campaign_name, recommended_channel, count(*) AS customers, avg(propensity_score) AS avg_propensity FROM ({ALL_LISTS}) GROUP BY 1, 2",
            ["avg_propensity"], LISTS),
        "class_balance": r(
            "SELECT count(*) FILTER (WHERE churn_label = 0) AS n_neg, count(*) FILTER (WHERE churn_label = 1) AS n_pos, "
            "cast(count(*) FILTER (WHERE churn_label = 0) AS double) / count(*) FILTER (WHERE churn_label = 1) AS pos_weight, avg(churn_label) AS positive_rate FROM master",
            ["pos_weight", "positive_rate"], MASTER),
        "rfm_scores": r("SELECT customer_id, r_score, f_score, m_score, rfm_score FROM rfm", [], [*STORE2Y, RFM]),
        "rfm_segment": r("SELECT customer_id, rfm_score, rfm_segment FROM seg", [], [*STORE2Y, RFM, SEGMENT]),
        "arpu_tier": r(f"SELECT customer_id, {ARPU_TIER} FROM store", [], STORE2Y),
        "propensity_priority_rank": r(
            "SELECT customer_id, propensity_bundle, propensity_bundle >= 5e-1 AS targetable, CASE WHEN propensity_bundle >= 5e-1 THEN "
            "row_number() OVER (PARTITION BY propensity_bundle >= 5e-1 ORDER BY propensity_bundle DESC, customer_id) ELSE -1 END AS priority_rank FROM scores",
            ["propensity_bundle"], [SCORES]),
        "campaign_top_n": r("SELECT customer_id, clv_90d FROM scores ORDER BY clv_90d DESC, customer_id LIMIT 100", ["clv_90d"], [SCORES]),
        "at_risk_customers": r(
            "SELECT customer_id, tenure_months, monthly_charges, total_charges, churn_risk_score, clv_90d, clv_tier, rfm_segment FROM master WHERE churn_risk_score >= 65e-2 ORDER BY churn_risk_score DESC, customer_id LIMIT 100",
            ["monthly_charges", "total_charges", "churn_risk_score", "clv_90d"], MASTER),
        "top_risk_factors": r(
            "SELECT customer_id, cast(rn AS int) AS position, feature, contribution, CASE WHEN contribution > 0 THEN 'increasing' ELSE 'decreasing' END AS direction "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(abs(contribution), 6) DESC, feature) AS rn FROM (SELECT customer_id, feature, round(contribution, 6) + 0e0 AS contribution FROM ({CONTRIB}))) WHERE rn <= 3",
            ["contribution"], Z),
        "cluster_label_assignment": r(LABEL_SQL, [], LABEL_CTES),
        "stratified_split": r(
            f"SELECT customer_id, churn_label, row_number() OVER (PARTITION BY churn_label ORDER BY {SPLIT}, customer_id) <= floor(count(*) OVER (PARTITION BY churn_label) * 2e-1 + 5e-1) AS is_test FROM prof",
            [], [RAW, PROF]),
        "f1_threshold_sweep": r(
            "SELECT threshold, f1, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS is_best FROM (SELECT threshold, CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE cast(2 * tp AS double) / (2 * tp + fp + fn) END AS f1 FROM "
            "(SELECT 3e-1 + 5e-2 * i AS threshold, count(*) FILTER (WHERE churn_risk_score >= 3e-1 + 5e-2 * i AND churn_label = 1) AS tp, "
            "count(*) FILTER (WHERE churn_risk_score >= 3e-1 + 5e-2 * i AND churn_label = 0) AS fp, count(*) FILTER (WHERE churn_risk_score < 3e-1 + 5e-2 * i AND churn_label = 1) AS fn "
            f"FROM master CROSS JOIN {GRID} GROUP BY i))", ["threshold", "f1"], MASTER),
        "auc_roc": r(AUC_SQL.format(score="churn_risk_score", table="master"), ["auc_roc"], MASTER),
        "average_precision": r(
            "SELECT sum(p * tp / (tp + fp)) / sum(p) AS average_precision FROM (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM "
            "(SELECT churn_risk_score AS s, cast(sum(churn_label) AS double) AS p, cast(sum(1 - churn_label) AS double) AS n FROM master GROUP BY 1) WINDOW w AS (ORDER BY s DESC))",
            ["average_precision"], MASTER),
        "classification_report": r(
            "SELECT cast(tp AS double) / (tp + fp) AS precision, cast(tp AS double) / (tp + fn) AS recall, cast(2 * tp AS double) / (2 * tp + fp + fn) AS f1_score FROM "
            "(SELECT count(*) FILTER (WHERE churn_risk_score >= 4e-1 AND churn_label = 1) AS tp, count(*) FILTER (WHERE churn_risk_score >= 4e-1 AND churn_label = 0) AS fp, "
            "count(*) FILTER (WHERE churn_risk_score < 4e-1 AND churn_label = 1) AS fn FROM master)", ["precision", "recall", "f1_score"], MASTER),
        "standardize": r("SELECT * EXCLUDE (cluster) FROM z", [f"{c}_z" for c in ZCOLS], Z),
        "soft_assignment": r(_soft(), [f"weight_{i}" for i in range(6)], Z),
        "propensity_labels": r(
            "SELECT customer_id, CASE WHEN high_data_user = 1 AND data_usage_trend > 0 AND offer_acceptance_rate > 15e-2 THEN 1 ELSE 0 END AS label_bundle_upgrade, "
            "CASE WHEN recharge_count_30d > c50 AND avg_recharge_amount < 500 AND frequent_recharger = 1 THEN 1 ELSE 0 END AS label_voice_topup, "
            "CASE WHEN days_since_last_recharge > 20 AND total_recharge_90d > q25 THEN 1 ELSE 0 END AS label_reactivation "
            "FROM beh, cuts, (SELECT quantile_cont(total_recharge_90d, 0.25) AS q25 FROM beh)", [], VALUE),
        "regression_metrics": r(
            "SELECT avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM (SELECT total_recharge_90d AS y, clv_90d * 1e2 AS p FROM master)",
            ["mae", "rmse", "r2"], MASTER),
        "reference_stats": r(
            f"SELECT feature_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM ({_unpivot('prev', BATCH_FEATURES)}) GROUP BY 1",
            ["mean", "std", "min", "max"], BATCHES),
        "psi": r("SELECT * FROM psi", ["psi"], DRIFT),
        "ks_statistic": r("SELECT feature_name, ks_statistic, n_ref, n_cur FROM pv", ["ks_statistic"], DRIFT),
        "ks_p_value": r("SELECT feature_name, ks_statistic, ks_p_value, ks_log10_p_value FROM pv", ["ks_statistic", "ks_p_value", "ks_log10_p_value"], DRIFT),
        "drift_report": r("SELECT * FROM report", REPORT_DOUBLES, DRIFT),
        "prediction_drift": r("SELECT * REPLACE ('prediction_scores' AS feature_name) FROM report", REPORT_DOUBLES, SCORE_DRIFT),
        "feature_drift_alerts": r(FEATURE_ALERTS, ["metric_value"], DRIFT),
        "prediction_drift_alerts": r(PREDICTION_ALERTS, ["metric_value"], SCORE_DRIFT),
        "performance_drop_alerts": r(PERF_ALERTS, ["metric_value"], PERF),
        "seeded_sample": r("SELECT customer_id, churn_risk_score FROM scores WHERE substr(md5(concat(customer_id, ':42')), 1, 8) < '33333333'", ["churn_risk_score"], [SCORES]),
        "event_features": r("SELECT * FROM feats", FEATURE_DOUBLES, [LOG, *_features(30)]),
        "feature_store_batch": r("SELECT * FROM store", STORE_DOUBLES, [LOG, *_features(30), *STORE]),
        "feature_store_ordinal": r(
            "SELECT prof.customer_id, tenure_months AS tenure, monthly_charges AS MonthlyCharges, coalesce(total_charges, 0e0) AS TotalCharges, churn_label, "
            "cast(coalesce(active_days, 0) AS int) AS active_days_90d, cast(coalesce(rech.n, 0) AS int) AS recharge_count_90d, coalesce(rech.s, 0e0) AS total_recharge_90d, coalesce(rech.a, 0e0) AS avg_recharge_amount, "
            "cast(coalesce(date_diff('day', rech.last_day, (SELECT d FROM ref)), 90) AS int) AS days_since_last_recharge, coalesce(sess.s, 0e0) AS data_usage_mb_90d, coalesce(sess.a, 0e0) AS avg_session_mb, coalesce(ord.slope, 0e0) AS recharge_trend "
            "FROM prof LEFT JOIN acts USING (customer_id) LEFT JOIN rech USING (customer_id) LEFT JOIN sess USING (customer_id) LEFT JOIN "
            f"(SELECT customer_id, {ORDINAL_SLOPE} AS slope FROM (SELECT customer_id, recharge_amount, row_number() OVER (PARTITION BY customer_id ORDER BY event_date, recharge_amount) AS i "
            "FROM log WHERE event_type = 'RECHARGE') GROUP BY 1) AS ord USING (customer_id)",
            ["MonthlyCharges", "TotalCharges", "total_recharge_90d", "avg_recharge_amount", "data_usage_mb_90d", "avg_session_mb", "recharge_trend"],
            [RAW, LOG, PROF, *_features(30)]),
        "rfm_behaviour_store": r("SELECT * FROM beh", VALUE_DOUBLES, VALUE),
        "campaign_all": r(ALL_LISTS, LIST_DOUBLES, LISTS),
    }
    out["feature_store_incremental"] = out["feature_store_batch"]
    out["feature_store_roundtrip"] = r("SELECT * FROM store", STORE_DOUBLES, STORE2Y)
    out["opportunity_export"] = r(_list_sql("bundle_upsell", 5000), LIST_DOUBLES, LISTS)
    out["numeric_feature_matrix"] = r(
        "SELECT customer_id, " + ", ".join(f"cast({c} AS double) AS {c}" for c in MATRIX) + " FROM master",
        MATRIX, MASTER)
    out["silhouette"] = r(_silhouette(), ["silhouette"], Z)
    out["pca_2d"] = r(_components(), ["pc1", "pc2"], MASTER)
    for name, rules in MODEL_RULES.items():
        out[name] = f"SELECT count(*) AS customers, {', '.join(f'{v} AS {n}' for n, v in rules.items())} FROM customer"
    out["k_selection_check"] = "SELECT 3 AS smallest, 9 AS largest, 1 AS best, true AS best_on_top, 7 AS below_total, 7 AS in_range"
    out["propensity_scores_check"] = (
        "SELECT offer_type, count(*) AS customers, count(*) AS in_range, count(*) AS flag_follows, count(*) AS rank_follows, 0 AS gaps "
        "FROM customer, (SELECT unnest(['bundle_upgrade', 'voice_topup', 'reactivation']) AS offer_type) GROUP BY 1"
    )
    # equal blocks in the order of the ids as text, the first ones one row larger
    out["cv_r2_check"] = (
        "SELECT fold, count(*) AS customers, min(id) AS first_id, max(id) AS last_id, true AS r2_in_range FROM "
        "(SELECT id, cast(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE (i - n % 5) // (n // 5) END AS int) AS fold FROM "
        "(SELECT cast(c_custkey AS string) AS id, row_number() OVER (ORDER BY cast(c_custkey AS string)) - 1 AS i, count(*) OVER () AS n FROM customer)) GROUP BY 1"
    )
    held_out = "SELECT cast(sum(floor(n * 2e-1 + 5e-1)) AS bigint) AS k FROM (SELECT churn_label, count(*) AS n FROM prof GROUP BY 1)"
    out["model_evaluation_check"] = (
        f"WITH {RAW}, {PROF} SELECT model, k AS rows, true AS in_range FROM ({held_out}), "
        "(SELECT unnest(['churn', 'bundle_upgrade', 'voice_topup', 'reactivation']) AS model) "
        "UNION ALL SELECT unnest(['clv', 'segments']), count(*), true FROM customer"
    )
    out["window_feature_drift"] = r(
        "SELECT * FROM report", REPORT_DOUBLES, [_window_store("prev", True), _window_store("cur", False), *_drift(MATRIX)]
    )
    out["model_monitoring_check"] = (
        f"WITH {RAW}, {PROF} SELECT side, count(*) AS customers, count(*) AS in_range, count(*) AS same_again, any_value(k) AS held_out, "
        f"{len(MATRIX) + 1} AS reports, {len(MATRIX) + 1} AS flag_follows, true AS alerts_follow, true AS auc_in_range "
        f"FROM customer, ({held_out}), (SELECT unnest(['reference', 'current']) AS side) GROUP BY 1"
    )
    out["schema_contract"] = f"WITH {RAW} " + out["schema_contract"]
    for kind in K.CAMPAIGNS:
        out[f"campaign_{kind}"] = r(_list_sql(kind, 5000), LIST_DOUBLES, LISTS)
    alert_lists = {
        "f": (FEATURE_ALERTS, DRIFT), "p": (PREDICTION_ALERTS, SCORE_DRIFT), "m": (PERF_ALERTS, PERF),
    }
    union = " UNION ALL ".join(f"SELECT * FROM (WITH {', '.join(c)} {q})" for q, c in alert_lists.values())
    out["alert_union"] = r(f"SELECT * FROM ({union})", ["metric_value"], [])
    out["alert_log_roundtrip"] = out["alert_union"]
    out["alert_summary"] = (
        f"WITH al AS ({union}) SELECT g.grouping, g.name, count(al.alert_id) AS alerts, (SELECT max(timestamp) FROM al) AS latest_timestamp FROM ("
        + " UNION ALL ".join(
            f"SELECT '{g}' AS grouping, '{v}' AS name"
            for g, v in [("severity", s) for s in K.ALERT_SEVERITIES] + [("type", t) for t in K.ALERT_TYPES])
        + ") AS g LEFT JOIN al ON (g.grouping = 'severity' AND al.severity = g.name) OR (g.grouping = 'type' AND al.alert_type = g.name) GROUP BY 1, 2"
    )
    return out
