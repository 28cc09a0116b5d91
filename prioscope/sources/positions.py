"""Positions of rows in the files they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read_with_positions(spark: SparkSession, path: str, name: str = "row_index") -> DataFrame:
    """A Parquet table with the zero-based position of every row over all files, in the order of their paths.

    A position is the row's own index in its file plus the rows of the files before
    it: nothing is sorted and no row is shuffled. The sums have one row per file.
    """
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_file").agg((F.max("_at") + 1).alias("_rows"))
    offsets = sizes.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # One row per file; the join's other side keeps its order and its place.
    return placed.join(offsets, "_file").select(
        *[F.col(f"`{c.replace('`', '``')}`") for c in rows.columns], (F.col("_before") + F.col("_at")).alias(name))
