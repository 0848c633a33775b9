"""Schemas of the inputs and the checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subscope import constants as K

PROFILE_TYPES = {"SeniorCitizen": T.IntegerType(), "tenure": T.IntegerType(), "MonthlyCharges": T.DoubleType()}
EVENT_TYPES = {
    "event_date": T.DateType(),
    "recharge_amount": T.DoubleType(),
    "data_mb_used": T.DoubleType(),
    "call_duration_minutes": T.DoubleType(),
}
PROFILE_SCHEMA = T.StructType([T.StructField(c, PROFILE_TYPES.get(c, T.StringType())) for c in K.PROFILE_COLUMNS])
# offer_accepted stays text: it may hold booleans, 1 or 'True'
EVENT_SCHEMA = T.StructType([T.StructField(c, EVENT_TYPES.get(c, T.StringType())) for c in K.EVENT_COLUMNS])


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def schema_contract(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: is it there, and how many rows have a value."""
    has = set(df.columns)
    filled = [F.count(F.col(c)) if c in has else F.lit(0).cast("bigint") for c in required]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(c in has).alias("present"), n.alias("filled_rows")
        )
        for c, n in zip(required, filled)
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
