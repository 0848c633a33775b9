"""Scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from subscope.sources.contracts import EVENT_SCHEMA, PROFILE_SCHEMA, require_columns


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    if fmt == "csv":
        # unreadable values become null, the row stays
        return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", dateFormat="yyyy-MM-dd")
    if fmt == "parquet":
        df = spark.read.parquet(path)
        require_columns(df, schema.names)
        return df.select(*schema.names)
    raise ValueError(f"unknown format: {fmt}")


def read_profiles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, PROFILE_SCHEMA)


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, EVENT_SCHEMA)


def read_store(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)
