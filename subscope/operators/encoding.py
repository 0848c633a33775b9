"""Profile cleaning and encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subscope import constants as K
from subscope.functions.cleaning import as_number, yes_no



def clean_profiles(raw: DataFrame) -> DataFrame:
    """Trim the key, read TotalCharges as a number, label churn 1/0 and senior Yes/No."""
    senior = F.col("SeniorCitizen").cast("string")
    return raw.withColumns(
        {
            "customerID": F.trim("customerID"),
            "TotalCharges": as_number("TotalCharges"),
            "SeniorCitizen": F.when(senior == "0", "No").when(senior == "1", "Yes").otherwise(senior),
            "churn_label": yes_no("Churn"),
        }
    )


def normalize_profile(df: DataFrame) -> DataFrame:
    """Rename to the feature-store names and turn Yes/No answers into 1/0."""
    no_service = ("No internet service",)
    numbers = {c: as_number(c) for c in ("MonthlyCharges", "TotalCharges")}
    answers = {c: yes_no(c) for c in K.YES_NO_COLUMNS}
    add_ons = {c: yes_no(c, no_service) for c in K.ADD_ON_COLUMNS}
    return df.withColumns({**numbers, **answers, **add_ons}).withColumnsRenamed(
        {
            "customerID": "customer_id",
            "tenure": "tenure_months",
            "MonthlyCharges": "monthly_charges",
            "TotalCharges": "total_charges",
        }
    )


def one_hot_fixed(df: DataFrame, spec: dict[str, dict[str, str]] = K.INDICATORS) -> DataFrame:
    """Indicator columns of a fixed vocabulary replace their source column; null gives all 0."""
    used = [c for c in spec if c in df.columns]
    out = {}
    for source in used:
        level = F.lower(source)
        synonyms = K.LEVEL_SYNONYMS.get(source, {})
        for name, wanted in spec[source].items():
            spellings = [wanted, *[s for s, full in synonyms.items() if full == wanted]]
            out[name] = F.coalesce(level.isin(*spellings), F.lit(False)).cast("int")
    return df.withColumns(out).drop(*used)


def one_hot_dynamic(
    df: DataFrame, column: str, drop_first: bool = True, levels: Sequence[str] | None = None
) -> DataFrame:
    """Indicators of the given levels, else of those found in the data, the first one dropped.

    Levels become columns of the schema, so they are aggregated up front, one row each; name them where
    the vocabulary is fixed.
    """
    if levels is None:
        found = df.select(column).where(F.col(column).isNotNull()).distinct()
        levels = [r[0] for r in found.collect()]
    levels = sorted(levels)[1 if drop_first else 0 :]
    return df.withColumns(
        {f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in levels}
    ).drop(column)


def fill_missing(df: DataFrame) -> DataFrame:
    """Null numbers become 0, other nulls 'Unknown'."""
    return df.na.fill(0).na.fill("Unknown")


def numeric_columns(df: DataFrame, exclude: list[str] = K.NON_FEATURES) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]
