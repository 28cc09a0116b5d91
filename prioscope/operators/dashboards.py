"""The tables behind the dashboard charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def overall_counts(df: DataFrame, label: str = "predicted_label") -> DataFrame:
    flagged = F.count_if(F.col(label) == 1)
    return df.agg((F.count("*") - flagged).alias("consistent"), flagged.alias("mismatch"))


def mismatch_type_counts(df: DataFrame) -> DataFrame:
    flagged = df.where(F.col("predicted_label") == 1)
    return flagged.groupBy("mismatch_type").agg(F.count("*").alias("n"))


def delta_heatmap(df: DataFrame, channels: Sequence[str], category: str = "category", channel: str = "channel",
                  others: str = "Other") -> DataFrame:
    """Mean severity delta, one row per category and one column per listed channel.

    All channels that are not listed, null included, share the column `others`.
    """
    means = [F.avg(F.when(F.col(channel) == name, F.col("severity_delta"))).alias(name) for name in channels]
    listed = F.coalesce(F.col(channel).isin(*channels), F.lit(False))
    return df.groupBy(category).agg(*means, F.avg(F.when(~listed, F.col("severity_delta"))).alias(others))
