"""Resolution times: free text or numbers to minutes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import BLANK, NOT_BLANK, strip

NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(col: Column) -> Column:
    """Double when the whole value is a number, else null."""
    text = strip(col.cast("string"))
    number = F.when(text.rlike(NUMERIC), text.try_cast("double"))
    return F.when(F.isnan(number), None).otherwise(number)


def parse_minutes(col: Column, default_unit: str = "minutes") -> Column:
    """Minutes from `H:M:S`, a count of days or hours, or a bare number.

    A bare number counts as `default_unit` ("minutes" or "hours"); text without
    a readable number gives null.
    """
    if default_unit not in ("minutes", "hours"):
        raise ValueError(f"unknown unit: {default_unit}")
    text = F.lower(col.cast("string"))
    clock = rf"^{BLANK}*(\d+):(\d+):(\d+)"
    # Without a clock the groups are empty and the sum is null.
    hours, minutes, seconds = (F.regexp_extract(text, clock, i).try_cast("double") for i in (1, 2, 3))
    number = F.regexp_substr(text, F.lit(r"[0-9.]+")).try_cast("double")
    unit = F.when(text.contains("day"), 1440).when(text.contains("hour"), 60).otherwise(
        60 if default_unit == "hours" else 1)
    return F.coalesce(hours * 60 + minutes + seconds / 60, number * unit)


def hours_to_minutes(col: Column) -> Column:
    return col * 60


def first_token_number(col: Column) -> Column:
    """Number in front of the first blank, else null."""
    token = F.regexp_substr(col.cast("string"), F.lit(rf"{NOT_BLANK}+"))
    return to_number(token)


def starts_with_digit(col: Column) -> Column:
    return F.coalesce(col.cast("string").rlike(r"^[0-9]"), F.lit(False))


def default_unit_for(column_name: str) -> str:
    return "hours" if "hour" in column_name.lower() else "minutes"
