"""Replacing missing resolution times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.durations import first_token_number, starts_with_digit, to_number
from .quantiles import quantiles

# Fill-ins in minutes.
NO_DIGIT_MINUTES = 30.0
ALL_MISSING_MINUTES = 30.0
DEFAULT_MINUTES = 60.0


def median_filled(df: DataFrame, value: str, out: str, last_resort: float | None = None) -> DataFrame:
    """Nulls of a numeric column become its median, or `last_resort` when it has no value."""
    median = quantiles(df, {"median": (value, 0.5)})["median"]
    filler = last_resort if median is None else median
    return df.withColumn(out, F.coalesce(value, F.lit(filler).cast("double")))


def fill_median(df: DataFrame, raw: str, out: str = "resolution_minutes") -> DataFrame:
    """Numbers stay, everything else becomes the median of the numbers."""
    return median_filled(df.withColumn("_number", to_number(F.col(raw))), "_number", out).drop("_number")


def fill_first_token_when_sparse(df: DataFrame, raw: str, out: str = "resolution_minutes") -> DataFrame:
    """When over half the values are no numbers, read first tokens; then fill the median.

    In that case values that do not start with a digit become 30.
    """
    numbers = df.withColumn("_number", to_number(F.col(raw)))
    if numbers.agg(F.count_if(F.col("_number").isNull()) > F.count("*") * 0.5).first()[0]:
        numbers = numbers.withColumn("_number", F.when(
            starts_with_digit(F.col(raw)), first_token_number(F.col(raw))).otherwise(NO_DIGIT_MINUTES))
    return median_filled(numbers, "_number", out).drop("_number")


def fill_first_token_when_empty(df: DataFrame, raw: str, out: str = "resolution_minutes") -> DataFrame:
    """When no value is a number, read first tokens; then fill the median, or 30 if still empty."""
    numbers = df.withColumn("_number", to_number(F.col(raw)))
    if not numbers.agg(F.count("_number")).first()[0]:
        numbers = numbers.withColumn("_number", first_token_number(F.col(raw)))
    return median_filled(numbers, "_number", out, ALL_MISSING_MINUTES).drop("_number")


def fixed_fill(raw: Column, minutes: float = DEFAULT_MINUTES) -> Column:
    """Numbers stay, everything else becomes a constant."""
    return F.coalesce(to_number(raw), F.lit(minutes))
