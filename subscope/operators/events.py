"""Per-customer features of the event log.

Everything rests on one rollup: (customer, day, channel) sums are additive, and day offsets
are constant inside a day, so counts, windows, last dates, distinct days, both least-squares
trends, the most used channel and the reference day all follow from it. The first aggregation
combines map-side, so a customer with a third of the log is spread by day and reaches the
later ones with a few rows per day. A function takes the log, or a rollup of it: rollups of
disjoint parts of a log, put one under the other, are a rollup of the whole.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope import constants as K
from subscope.functions.cleaning import has_offer, is_accepted
from subscope.functions.stats import slope
from subscope.operators.ordering import running_sums
from subscope.session import materialize, small_tasks

ORIGIN = "2000-01-01"  # days of a trend are counted from here; a slope does not depend on it


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def reference_dates(events: DataFrame) -> DataFrame:
    """First and last event date of the log, one row."""
    return events.agg(F.min("event_date").alias("min_date"), F.max("event_date").alias("max_date"))


def _ref(events: DataFrame, ref: date | str | None) -> Column:
    """Reference day: the given one, else the last day of the log as a scalar subquery."""
    if ref is None:
        return reference_dates(events).select("max_date").scalar()
    return F.lit(str(ref)).cast("date")


def filter_events(
    events: DataFrame, kind: str | None = None, ref: date | str | None = None, days: int | None = None
) -> DataFrame:
    """Events of one type and/or of the last ``days`` days, the cutoff day included."""
    out = events if kind is None else events.where(_ROLLED_KIND[kind] if is_rollup(events) else _is(kind))
    if days is not None:
        out = out.where(F.col("event_date") >= F.date_sub(_ref(events, ref), days))
    return out


def offer_flags(events: DataFrame) -> DataFrame:
    return events.withColumns({"has_offer": has_offer(), "is_accepted": is_accepted()})


SUMS = [
    "n_events", "n_offers", "n_accepted", "n_app", "recharge_rows", "recharge_n", "recharge_sum",
    "session_rows", "session_n", "session_sum",
]
_ROLLED_KIND = {"RECHARGE": "recharge_rows > 0", "DATA_SESSION": "session_rows > 0"}


def is_rollup(events: DataFrame) -> bool:
    return "n_events" in events.columns


def _rolled_by(events: DataFrame, *keys: str) -> DataFrame:
    """Sums by the given keys. Columns nobody asks for are pruned by the optimizer."""
    if is_rollup(events):
        return events.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
    recharge, session = _is("RECHARGE"), _is("DATA_SESSION")
    sums = (
        F.count(F.lit(1)),
        F.count_if(has_offer()),
        F.count_if(is_accepted()),
        F.count_if(F.col("channel") == "APP"),
        F.count_if(recharge),
        F.count(F.when(recharge, F.col("recharge_amount"))),
        F.sum(F.when(recharge, F.col("recharge_amount"))),
        F.count_if(session),
        F.count(F.when(session, F.col("data_mb_used"))),
        F.sum(F.when(session, F.col("data_mb_used"))),
    )
    return events.groupBy(*keys).agg(*[c.alias(name) for name, c in zip(SUMS, sums)])


def channel_rollup(events: DataFrame) -> DataFrame:
    """One row per customer, day and channel: all that the event features need of the log."""
    return _rolled_by(events, "customer_id", "event_date", "channel")


def daily_rollup(events: DataFrame) -> DataFrame:
    """One row per customer and day."""
    return _rolled_by(events, "customer_id", "event_date")


def stored_rollup(events: DataFrame) -> DataFrame:
    """The rollup as a table, so that the log is joined and scanned once; a rollup is taken as it is."""
    if is_rollup(events):
        return events
    with small_tasks(events.sparkSession):
        return materialize(channel_rollup(events), "rollup")


def _dated(daily: DataFrame, ref_day: Column) -> DataFrame:
    """Add ``ago``, days before the reference day, so the reference is looked up once per plan."""
    return daily.withColumn("ago", F.datediff(ref_day, F.col("event_date")).cast("bigint"))


def _total(name: str, only: Column | None = None) -> Column:
    return F.coalesce(F.sum(name if only is None else F.when(only, F.col(name))), F.lit(0))


def _day_slope(weight: Column, amount: str) -> Column:
    """Trend over days of points given by daily weights and daily sums; rows without a date are no points."""
    x = F.datediff(F.col("event_date"), F.lit(ORIGIN).cast("date")).cast("bigint")
    dated = F.col("event_date").isNotNull()
    y = F.when(dated, F.coalesce(F.col(amount), F.lit(0)))
    return slope(F.sum(F.when(dated, weight)), F.sum(weight * x), F.sum(y), F.sum(x * y), F.sum(weight * x * x))


def _mean(amount: str, count: str) -> Column:
    return F.try_divide(F.sum(amount).cast("double"), F.sum(count))


def activity_agg(events: DataFrame, ref: date | str | None = None) -> DataFrame:
    """Distinct active days, last activity, number of events, days since last activity."""
    daily = _dated(daily_rollup(events), _ref(events, ref))
    return daily.groupBy("customer_id").agg(
        F.count("event_date").alias("active_days_90d"),
        F.max("event_date").alias("last_activity_date"),
        F.sum("n_events").alias("total_events_count"),
        F.min("ago").cast("int").alias("days_since_last_activity"),
    )


def recharge_agg(
    events: DataFrame, ref: date | str | None = None, window_days: int | None = None
) -> DataFrame:
    """Count, sum, average, last date and recency of recharges, over the log or its last days."""
    rows = filter_events(events, "RECHARGE", ref, window_days)
    daily = _dated(daily_rollup(rows), _ref(events, ref))
    return daily.groupBy("customer_id").agg(
        F.sum("recharge_n").alias("recharge_count"),
        _total("recharge_sum").cast("double").alias("total_recharge"),
        _mean("recharge_sum", "recharge_n").alias("avg_recharge_amount"),
        F.max("event_date").alias("last_recharge_date"),
        F.min("ago").cast("int").alias("days_since_last_recharge"),
    )


def ordinal_block(events: DataFrame, ref: date | str | None = None) -> DataFrame:
    """Features of the smaller store: one pass over the log for all sums, which count recharge rows with or
    without an amount, and one over the recharges for the trend."""
    rolled = stored_rollup(events)
    daily = _dated(daily_rollup(rolled), _ref(rolled, ref))
    had_recharge = F.col("recharge_rows") > 0
    block = daily.groupBy("customer_id").agg(
        F.count("event_date").alias("active_days_90d"),
        F.sum("recharge_rows").alias("recharge_count_90d"),
        F.sum("recharge_sum").cast("double").alias("total_recharge_90d"),
        _mean("recharge_sum", "recharge_n").alias("avg_recharge_amount"),
        F.min(F.when(had_recharge, F.col("ago"))).cast("int").alias("days_since_last_recharge"),
        F.sum("session_sum").cast("double").alias("data_usage_mb_90d"),
        _mean("session_sum", "session_n").alias("avg_session_mb"),
    )
    return block.join(trend_ordinal(events), "customer_id", "left")


def data_usage_agg(
    events: DataFrame, ref: date | str | None = None, short: int = 30, long: int | None = None
) -> DataFrame:
    """Data volume over the long and the short window, and the average session."""
    daily = _dated(daily_rollup(filter_events(events, "DATA_SESSION", ref, long)), _ref(events, ref))
    return daily.groupBy("customer_id").agg(
        _total("session_sum").cast("double").alias("data_usage_mb_90d"),
        _mean("session_sum", "session_n").alias("avg_session_mb"),
        _total("session_sum", F.col("ago") <= short).cast("double").alias("data_usage_mb_30d"),
    )


def offer_acceptance(events: DataFrame) -> DataFrame:
    """Offers shown, offers taken and their ratio (0 where none was shown)."""
    shown, taken = F.count_if(has_offer()), F.count_if(is_accepted())
    return events.groupBy("customer_id").agg(
        shown.alias("offers_presented"),
        taken.alias("offers_accepted"),
        F.coalesce(F.try_divide(taken, shown), F.lit(0.0)).alias("offer_acceptance_rate"),
    )


def app_usage_rate(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(
        (F.count_if(F.col("channel") == "APP") / F.count(F.lit(1))).alias("app_usage_rate")
    )


def preferred_channel(events: DataFrame) -> DataFrame:
    """Most used channel; ties go to the first name, nulls do not count."""
    n = F.sum("n_events") if is_rollup(events) else F.count(F.lit(1))
    per_channel = events.where(F.col("channel").isNotNull()).groupBy("customer_id", "channel").agg(n.alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("channel")))
    return per_channel.groupBy("customer_id").agg(best["channel"].alias("preferred_channel"))


def recharge_trend(events: DataFrame) -> DataFrame:
    """Slope of recharge amount over days, each recharge one point."""
    daily = daily_rollup(filter_events(events, "RECHARGE"))
    return daily.groupBy("customer_id").agg(
        _day_slope(F.col("recharge_n"), "recharge_sum").alias("recharge_trend")
    )


def data_usage_trend(events: DataFrame) -> DataFrame:
    """Slope of daily data volume over days, each active day one point."""
    daily = daily_rollup(filter_events(events, "DATA_SESSION"))
    return daily.groupBy("customer_id").agg(
        _day_slope(F.lit(1).cast("bigint"), "session_sum").alias("data_usage_trend")
    )


def trend_ordinal(events: DataFrame) -> DataFrame:
    """Slope of recharge amount over the recharge's sequence number (by date, then amount).

    Equal (date, amount) pairs are interchangeable, so they are collapsed first; the
    sequence offset is a running count that spreads a huge customer over many tasks.
    """
    c, y = F.col("c"), F.col("recharge_amount")
    points = (
        filter_events(events, "RECHARGE")
        .where(F.col("recharge_amount").isNotNull() & F.col("event_date").isNotNull())
        .groupBy("customer_id", "event_date", "recharge_amount")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    placed = running_sums(points, ["event_date", "recharge_amount"], {"upto": c}, by=["customer_id"])
    n = F.sum("c").cast("decimal(20,0)")
    # the c positions ending at `upto` sum to half of this; over 1..n both sums of the slope are known
    twice = 2 * c * F.col("upto") - c * (c - 1)
    top = (n * F.sum(twice * y) - n * (n + 1) * F.sum(c * y)).cast("double") * 6.0
    m = n.cast("double")
    return placed.groupBy("customer_id").agg(
        F.coalesce(F.try_divide(top, m * m * (m * m - 1)), F.lit(0.0)).alias("recharge_trend")
    )


def event_block(
    events: DataFrame, ref: date | str | None = None, short: int = 30, long: int | None = None
) -> DataFrame:
    """All event features before defaults, from one pass over the log.

    Its rollup is a table, which the reference day, the sums and the channel mode are read from; the last two
    come out partitioned by customer and join without a further shuffle.
    """
    events = stored_rollup(events)
    log = filter_events(events, None, ref, long)
    recent = F.col("ago") <= short
    had_recharge, had_session = F.col("recharge_rows") > 0, F.col("session_rows") > 0
    shown, taken = F.sum("n_offers"), F.sum("n_accepted")
    daily = _dated(daily_rollup(log), _ref(events, ref))
    block = daily.groupBy("customer_id").agg(
        F.when(F.count_if(had_recharge) > 0, _total("recharge_n")).alias("recharge_count_90d"),
        F.when(F.count_if(had_recharge & recent) > 0, _total("recharge_n", recent)).alias("recharge_count_30d"),
        F.sum("recharge_sum").cast("double").alias("total_recharge_90d"),
        F.sum(F.when(recent, F.col("recharge_sum"))).cast("double").alias("total_recharge_30d"),
        _mean("recharge_sum", "recharge_n").alias("avg_recharge_amount"),
        F.min(F.when(had_recharge, F.col("ago"))).cast("int").alias("days_since_last_recharge"),
        _day_slope(F.col("recharge_n"), "recharge_sum").alias("recharge_trend"),
        F.sum(F.when(recent, F.col("session_sum"))).cast("double").alias("data_usage_mb_30d"),
        F.sum("session_sum").cast("double").alias("data_usage_mb_90d"),
        _day_slope(F.when(had_session, 1).otherwise(0).cast("bigint"), "session_sum").alias("data_usage_trend"),
        _mean("session_sum", "session_n").alias("avg_session_mb"),
        (F.sum("n_app") / F.sum("n_events")).alias("app_usage_rate"),
        shown.alias("offers_presented"),
        taken.alias("offers_accepted"),
        F.coalesce(F.try_divide(taken, shown), F.lit(0.0)).alias("offer_acceptance_rate"),
        F.count("event_date").alias("active_days_90d"),
        F.min("ago").cast("int").alias("days_since_last_activity"),
    )
    return block.join(preferred_channel(log), "customer_id", "left")


def event_features(
    events: DataFrame, ref: date | str | None = None, short: int = 30, long: int | None = None
) -> DataFrame:
    """The 19-column event feature block with its defaults filled in."""
    filled = fill_defaults(event_block(events, ref, short, long), K.EVENT_DEFAULTS)
    return filled.select(*K.EVENT_FEATURES)


INT_COLUMNS = [
    "recharge_count_30d", "recharge_count_90d", "offers_presented", "offers_accepted",
    "active_days_90d", "days_since_last_activity", "days_since_last_recharge",
]


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill nulls with per-column defaults and bring counters to int."""
    has = set(df.columns)
    filled = df.na.fill({c: v for c, v in defaults.items() if c in has})
    return filled.withColumns({c: F.col(c).cast("int") for c in INT_COLUMNS if c in has})
