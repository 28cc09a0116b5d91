"""Table profiles: sizes, types, missing values and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import round_exact
from ..functions.severity import LABELS
from .quantiles import quantiles
from .statistics import QUARTILES


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First n rows in the order of a key: a report of n rows."""
    return df.orderBy(key).limit(n)


def _per_column(df: DataFrame, measure, value_name: str) -> DataFrame:
    """One pass over the table, then one output row per column."""
    row = df.agg(*[measure(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(df.columns)])
    pairs = ", ".join(f"'{c}', '{t}', m{i}" for i, (c, t) in enumerate(df.dtypes))
    return row.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, data_type, {value_name})")


def column_info(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of every column."""
    return _per_column(df, F.count, "non_null")


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count of every column that has any."""
    out = _per_column(df, lambda c: F.count_if(c.isNull()), "missing")
    return out.where("missing > 0").drop("data_type")


def frequency(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """Rows per non-null value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(out)).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum in one row."""
    value = F.col(column)
    moments = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )
    found = quantiles(df, {name: (column, share) for name, share in QUARTILES.items()})
    row = moments.withColumns({name: F.lit(value).cast("double") for name, value in found.items()})
    names = ("mean", "std", "minimum", "p25", "p50", "p75", "maximum")
    return row.select("n", *[round_exact(F.col(name), digits).alias(name) for name in names])


def label_distribution(df: DataFrame, column: str, labels: Sequence[str] = LABELS[::-1]) -> DataFrame:
    """Count and percent of every label of the domain, absent ones included."""
    counts = df.agg(F.count("*").alias("_all"), *[
        F.count_if(F.col(column) == label).alias(f"m{i}") for i, label in enumerate(labels)])
    pairs = ", ".join(f"{i}, '{label}', m{i}" for i, label in enumerate(labels))
    rows = counts.selectExpr("_all", f"stack({len(labels)}, {pairs}) AS (position, label, n)")
    return rows.select("position", "label", "n", round_exact(F.try_divide(F.col("n") * 100, F.col("_all")), 1).alias("percent"))


def class_balance(df: DataFrame, column: str = "mismatch") -> DataFrame:
    """Consistent and mismatch counts with their shares in percent."""
    flagged: Column = F.count_if(F.col(column) == 1)
    rows = df.agg(F.count("*").alias("total"), flagged.alias("mismatch_count"))
    consistent = F.col("total") - F.col("mismatch_count")
    return rows.select(
        "total", "mismatch_count", consistent.alias("consistent_count"),
        round_exact(F.try_divide(F.col("mismatch_count") * 100, F.col("total")), 1).alias("mismatch_percent"),
        round_exact(F.try_divide(consistent * 100, F.col("total")), 1).alias("consistent_percent"),
    )
