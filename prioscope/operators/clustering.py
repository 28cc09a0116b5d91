"""Signal 2: severity of text clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.severity import LABELS, severity_label
from .kmeans import Clusters, fit_kmeans

RESTARTS = 10
MAX_ITERATIONS = 300
DEFAULT_SEVERITY = "Medium"


def rank_clusters(df: DataFrame, by: str = "time", minutes: str = "resolution_minutes",
                  cluster: str = "cluster_id") -> DataFrame:
    """Severity per cluster: by mean time ascending, or by size descending.

    At most four clusters have a severity; more raise at run time. Tickets
    without a cluster do not count.
    """
    stats = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.avg(minutes).alias("mean_minutes"), F.count("*").alias("tickets"))
    if by == "time":
        order = Window.orderBy("mean_minutes", cluster)
    elif by == "size":
        order = Window.orderBy(F.desc("tickets"), cluster)
    else:
        raise ValueError(f"rank clusters by time or size, not {by}")
    ranked = stats.withColumn("_rank", F.row_number().over(order))
    checked = F.when(F.col("_rank") > len(LABELS), F.raise_error(F.lit("more clusters than severities")).cast("string"))
    return ranked.withColumn("cluster_severity", checked.otherwise(severity_label(F.col("_rank")))).drop("_rank")


def attach_cluster_severity(df: DataFrame, ranking: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Look up each ticket's cluster severity; tickets without a ranked cluster get the default.

    The ranking has at most four rows.
    """
    ranked = ranking.where(F.col(cluster).isNotNull()).select(cluster, "cluster_severity")
    return df.join(F.broadcast(ranked), cluster, "left").withColumn(
        "cluster_severity", F.coalesce("cluster_severity", F.lit(DEFAULT_SEVERITY)))


def fit_clusters(df: DataFrame, vector: str, k: int = len(LABELS), seeds: Sequence[int] = range(42, 42 + RESTARTS),
                 max_iter: int = MAX_ITERATIONS) -> Clusters:
    """Best of several k-means runs by their cost, all fitted side by side."""
    return fit_kmeans(df, vector, k, list(seeds), max_iter)
