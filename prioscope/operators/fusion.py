"""From signals to a fused severity and a mismatch label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.severity import fuse_ceil_mean, fuse_majority, severity_label, severity_number
from .statistics import with_one_row

MISMATCH_GAP = 2


def attach_signal(tickets: DataFrame, signal: DataFrame, column: str, key: str = "ticket_id",
                  default: str = "Medium") -> DataFrame:
    """Left lookup of a signal label by ticket id; tickets without one get the default.

    A signal table with repeated ids contributes one row per id.
    """
    one_each = signal.groupBy(key).agg(F.min(column).alias(column))
    return tickets.join(one_each, key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def fuse(df: DataFrame, method: str = "ceil_mean",
         signals: Sequence[str] = ("llm_severity_score", "cluster_severity")) -> DataFrame:
    """Add fused_severity and fused_num from signal labels."""
    numbers = [severity_number(F.col(name)) for name in signals]
    if method == "ceil_mean":
        fused = fuse_ceil_mean(*numbers)
    elif method == "majority_vote":
        fused = fuse_majority(numbers)
    else:
        raise ValueError(f"unknown fusion: {method}")
    return df.withColumn("fused_num", fused).withColumn("fused_severity", severity_label(F.col("fused_num")))


def label_mismatch(df: DataFrame, lower_when_none: bool = True) -> DataFrame:
    """Add severity_delta and mismatch: fused and assigned severity at least two apart.

    When no ticket at all is that far apart, a gap of one counts. That needs a
    look at the whole table; without it (streams) the gap stays at two.
    """
    delta = df.withColumn("severity_delta", (F.col("fused_num") - F.col("assigned_num")).cast("int"))
    gap = F.abs("severity_delta")
    if not lower_when_none:
        return delta.withColumn("mismatch", (gap >= MISMATCH_GAP).cast("int"))
    widest = delta.agg((F.max(gap) >= MISMATCH_GAP).alias("_wide"))
    needed = F.when(F.col("_wide"), MISMATCH_GAP).otherwise(1)
    return with_one_row(delta, widest).withColumn("mismatch", (gap >= needed).cast("int")).drop("_wide")
