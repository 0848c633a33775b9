"""End-to-end flows from raw inputs to stores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from subscope import constants as K
from subscope.operators import encoding, events, profiles, value
from subscope.session import materialize


def feature_store(
    raw_profiles: DataFrame, log: DataFrame, ref: date | str | None = None,
    short: int = 30, long: int | None = None,
) -> DataFrame:
    """One wide row per customer.

    Event defaults are filled before the join, so a customer absent from the log ends with
    zeros everywhere, recency included.
    """
    clean = encoding.normalize_profile(encoding.clean_profiles(raw_profiles))
    lines = encoding.one_hot_dynamic(clean, "MultipleLines")
    joined = profiles.join_features(lines, events.event_features(log, ref, short, long))
    return encoding.fill_missing(encoding.one_hot_fixed(joined).drop("Churn"))


def feature_store_ordinal(raw_profiles: DataFrame, log: DataFrame, ref: date | str | None = None) -> DataFrame:
    """The smaller store: ordinal trend, defaults filled after the join (silent means 90 days)."""
    clean = encoding.clean_profiles(raw_profiles).na.fill({"TotalCharges": 0.0})
    block = events.ordinal_block(log, ref)
    joined = profiles.join_features(clean.withColumnRenamed("customerID", "customer_id"), block)
    return events.fill_defaults(joined, K.ORDINAL_DEFAULTS)


def value_store(
    raw_profiles: DataFrame, log: DataFrame, ref: date | str | None = None,
    short: int = 30, long: int | None = None,
) -> DataFrame:
    """Feature store with RFM and behaviour columns.

    The store is written once; one rank selection over five of its columns then gives every cut
    point, and the scores are a projection with those as literals.
    """
    return value_columns(materialize(feature_store(raw_profiles, log, ref, short, long), "store"))


def value_columns(store: DataFrame) -> DataFrame:
    """RFM and behaviour columns on top of a stored feature store."""
    cut = value.cutoffs(store)
    return value.with_behaviour(value.with_rfm_segment(value.rfm_scores(store, cut)), cut)
