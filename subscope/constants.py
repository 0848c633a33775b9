"""Names, thresholds and texts that results must carry as they are."""

SEED = 42
TEST_FRACTION = 0.2
FOLDS = 5
N_CLUSTERS = 6
CHURN_RISK_THRESHOLD = 0.65
PROPENSITY_THRESHOLD = 0.5
PSI_THRESHOLD = 0.2
PSI_WATCH = 0.1
KS_ALPHA = 0.05
AUC_DROP_WARNING = 0.02
AUC_DROP_CRITICAL = 0.05

PROFILE_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]

EVENT_COLUMNS = [
    "customer_id", "event_date", "event_type", "recharge_amount", "data_mb_used",
    "call_duration_minutes", "channel", "offer_presented", "offer_accepted",
]

RFM_COLUMNS = [
    "customer_id", "days_since_last_recharge", "recharge_count_30d", "total_recharge_30d",
]

YES_NO_COLUMNS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling"]
ADD_ON_COLUMNS = [
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies",
]

# source column -> {indicator column: level after lower-casing}
INDICATORS = {
    "gender": {"gender_male": "male"},
    "InternetService": {
        "internet_dsl": "dsl",
        "internet_fiber": "fiber optic",
        "internet_none": "no",
    },
    "Contract": {
        "contract_monthly": "month-to-month",
        "contract_1yr": "one year",
        "contract_2yr": "two year",
    },
    "PaymentMethod": {
        "payment_method_electronic_check": "electronic check",
        "payment_method_mailed_check": "mailed check",
        "payment_method_bank_transfer": "bank transfer (automatic)",
        "payment_method_credit_card": "credit card (automatic)",
    },
    "preferred_channel": {
        "preferred_channel_ussd": "ussd",
        "preferred_channel_app": "app",
        "preferred_channel_agent": "agent",
        "preferred_channel_web": "web",
    },
}

# short spellings that count as the level they stand for
LEVEL_SYNONYMS = {
    "InternetService": {"fiber": "fiber optic", "none": "no"},
    "Contract": {"monthly": "month-to-month", "1yr": "one year", "2yr": "two year"},
    "PaymentMethod": {
        "electronic_check": "electronic check",
        "mailed_check": "mailed check",
        "bank_transfer": "bank transfer (automatic)",
        "credit_card": "credit card (automatic)",
    },
}

# values of a customer whose log has no event of the kind a feature needs
EVENT_DEFAULTS = {
    "recharge_count_30d": 0,
    "recharge_count_90d": 0,
    "total_recharge_30d": 0.0,
    "total_recharge_90d": 0.0,
    "avg_recharge_amount": 0.0,
    "days_since_last_recharge": 90,
    "recharge_trend": 0.0,
    "data_usage_mb_30d": 0.0,
    "data_usage_mb_90d": 0.0,
    "data_usage_trend": 0.0,
    "avg_session_mb": 0.0,
    "offers_presented": 0,
    "offers_accepted": 0,
    "offer_acceptance_rate": 0.0,
    "app_usage_rate": 0.0,
    "preferred_channel": "USSD",
}

# the smaller feature set of the ordinal store, filled after the join
ORDINAL_DEFAULTS = {
    "recharge_count_90d": 0,
    "total_recharge_90d": 0.0,
    "avg_recharge_amount": 0.0,
    "days_since_last_recharge": 90,
    "data_usage_mb_90d": 0.0,
    "avg_session_mb": 0.0,
    "active_days_90d": 0,
    "recharge_trend": 0.0,
}

EVENT_FEATURES = [
    "customer_id", "recharge_count_30d", "recharge_count_90d", "total_recharge_30d",
    "total_recharge_90d", "avg_recharge_amount", "days_since_last_recharge",
    "recharge_trend", "data_usage_mb_30d", "data_usage_mb_90d", "data_usage_trend",
    "avg_session_mb", "preferred_channel", "app_usage_rate", "offers_presented",
    "offers_accepted", "offer_acceptance_rate", "active_days_90d",
    "days_since_last_activity",
]

NON_FEATURES = [
    "customer_id", "churn_label", "rfm_segment", "lifecycle_stage", "arpu_tier",
    "preferred_channel", "gender", "churn_risk_score", "segment_label", "ml_segment",
    "propensity_bundle", "propensity_topup", "propensity_reactivation", "clv_90d",
    "clv_tier",
]

TIERS = ["Platinum", "Gold", "Silver", "Bronze"]
TIER_WEIGHT = {"Platinum": 1.0, "Gold": 0.75, "Silver": 0.5, "Bronze": 0.25}
TIER_BUDGET = {
    "Platinum": "Premium", "Gold": "Standard", "Silver": "Basic", "Bronze": "Minimal",
}
TIER_INDEX = {"Platinum": 4.0, "Gold": 3.0, "Silver": 2.0, "Bronze": 1.0}
ARPU_TIERS = ["Bronze", "Silver", "Gold", "Platinum"]

CAMPAIGNS = [
    "churn_retention", "bundle_upsell", "voice_topup", "reactivation", "loyalty_reward",
]

FUNNEL_STAGES = ["New Active", "Active", "High Value Loyal", "Lapsing", "Churned"]

RISK_ACTIONS = {
    "Critical": "Immediate outreach: personal call + premium retention offer",
    "High": "Priority SMS: personalised discount bundle offer",
    "Medium": "Automated campaign: loyalty reward notification",
    "Low": "Standard nurture: regular engagement campaign",
}

# cluster role -> (label, description, campaign)
SEGMENT_TEXTS = {
    "dormant": (
        "Dormant",
        "No activity for a long time, low overall value.",
        "Win-back: massive discount on next recharge or reactivate bonus",
    ),
    "high_value": (
        "High Value Active",
        "High spend, frequent recharges, and low churn risk.",
        "Loyalty program: premium rewards & exclusive benefits",
    ),
    "at_risk": (
        "At Risk Heavyweights",
        "Previously high spenders now showing strong signs of churn.",
        "Immediate outreach: high-value retention offer & proactive call",
    ),
    "loyal": (
        "Loyal But Declining",
        "Long-term customers showing signs of declining activity.",
        "Retention campaign: targeted value offers & feedback survey",
    ),
    "price": (
        "Price Sensitive",
        "Frequent recharges of small amounts, low overall spend.",
        "Cross-sell: micro-bundles & low-cost weekly offers",
    ),
    "rising": (
        "Rising Stars",
        "Newer customers with high data usage and growth potential.",
        "Upsell: data bundle packages and gaming/streaming services",
    ),
}
OTHER_SEGMENT_TEXT = (
    "Custom customer segment based on behavioral clustering.",
    "Standard nurture: regular engagement campaign",
)

CLUSTER_METRICS = [
    "arpu", "recharge_count_30d", "days_since_last_recharge", "data_usage_mb_30d",
    "tenure_months", "churn_risk_score", "engagement_score",
]

ALERT_TYPES = ["DATA_DRIFT", "PREDICTION_DRIFT", "PERFORMANCE_DROP", "MISSING_DATA"]
ALERT_SEVERITIES = ["WARNING", "CRITICAL"]
ALERT_ACTIONS = {
    "retrain": "Retrain all models immediately. Feature distribution has shifted significantly.",
    "watch": "Monitor closely. Schedule retraining within 2 weeks.",
    "prediction": (
        "Investigate downstream: check if business conditions changed or data pipeline has issues."
    ),
    "performance": "Model accuracy below acceptable threshold. Prioritise retraining.",
}
ALERT_MESSAGES = {
    "feature": "Feature '%s' has drifted. PSI = %.4f (KS p-val = %.4f)",
    "prediction": "Prediction score distribution has shifted. PSI = %.4f (KS p-val = %.4f)",
    "performance": "Model performance drop detected on %s. Current AUC: %.4f (Ref: %.4f, drop: %.2f%%)",
}

OFFERS = {
    "retention_top": "Premium Retention Bundle",
    "retention_silver": "Loyalty Discount",
    "retention_other": "Standard Retention SMS",
    "bundle_light": "1GB Daily Bundle",
    "bundle_heavy": "5GB Monthly Bundle",
    "voice": "Voice Top-up: Get ₦100 bonus on ₦500 recharge",
    "reactivation": "Welcome Back: 2x data for 7 days",
    "loyalty_top": "Exclusive Bundle Discount",
    "loyalty_other": "Loyalty Points Bonus",
}
