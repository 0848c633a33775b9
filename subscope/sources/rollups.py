"""The event rollup as a store that grows with the log.

Each increment is the rollup of the events that have arrived since the last one, written by month. Sums of a customer, day and
channel may stand in several increments, late events of an old day among them: every feature adds them up, so the store is
read like a rollup of the whole log, and nothing that is there is rewritten.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope.operators.events import channel_rollup


def _month(day) -> object:
    return F.date_format(day, "yyyy-MM")


def add_increment(events: DataFrame, path: str, name: str) -> None:
    """Write the rollup of new events under a name of their own; written again, an increment replaces itself.

    Events without a date are kept in a partition without a month.
    """
    rolled = channel_rollup(events).withColumn("month", _month(F.col("event_date")))
    rolled.write.mode("overwrite").partitionBy("month").parquet(f"{path.rstrip('/')}/increment={name}")


def read_rollup(spark: SparkSession, path: str, since: date | str | None = None) -> DataFrame:
    """All increments as one rollup; with ``since`` only the months from that day on are read, and its earlier days left out."""
    store = spark.read.parquet(path)
    if since is not None:
        day = F.lit(str(since)).cast("date")
        store = store.where((F.col("month") >= _month(day)) & (F.col("event_date") >= day))
    return store.drop("increment", "month")


def compact(spark: SparkSession, path: str, target: str, name: str = "base") -> None:
    """The same store with one row per customer, day and channel, as a single increment in another folder."""
    add_increment(read_rollup(spark, path), target, name)
