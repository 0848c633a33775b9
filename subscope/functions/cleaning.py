"""Column expressions that bring raw values into shape. Bad input becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_number(name: str) -> Column:
    return F.trim(F.col(name).cast("string")).try_cast("double")


def yes_no(name: str, also_no: tuple[str, ...] = ()) -> Column:
    """Yes -> 1, No (and ``also_no``) -> 0, anything else null."""
    return F.when(F.col(name) == "Yes", 1).when(F.col(name).isin("No", *also_no), 0)


def coerce_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns, turning unreadable values into null (plain ``cast`` raises under ANSI)."""
    return df.withColumns(
        {c: F.trim(F.col(c).cast("string")).try_cast(t) for c, t in types.items()}
    )


def has_offer(name: str = "offer_presented") -> Column:
    c = F.col(name)
    return c.isNotNull() & ~c.isin("", "None")


def is_accepted(name: str = "offer_accepted") -> Column:
    """True for boolean true, 1 or the text 'True', whatever the column's type is."""
    return F.coalesce(F.col(name).cast("string").isin("true", "True", "1", "1.0"), F.lit(False))
