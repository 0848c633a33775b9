"""Feature store, target list and alert log outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope.operators.alerts import ALERT_SCHEMA
from subscope.operators.campaigns import RECORD_SCHEMA


def write_store(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)


def rfm_export(df: DataFrame, path: str | None = None) -> DataFrame:
    out = df.select("customer_id", "rfm_score")
    if path is not None:
        out.write.mode("overwrite").csv(path, header=True)
    return out


def write_opportunities(df: DataFrame, path: str, campaign: str, dt: str) -> str:
    """Write one target list, in rank order, to its dated folder; an empty list keeps its header."""
    target = f"{path.rstrip('/')}/campaign={campaign}/dt={dt}"
    rows = df.where(F.col("campaign_name") == campaign).orderBy(F.desc("priority_score"), "customer_id")
    rows.write.mode("overwrite").csv(target, header=True)
    return target


def read_opportunities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).csv(path, header=True)


def write_alerts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT_SCHEMA).json(path)
