"""Exact order statistics and row numbers without gathering rows in one task.

Ranks per group: rows are first counted per coarse bucket, which locates the wanted
ranks; the values of the few buckets that hold one are then counted and narrowed
twice more before a task sorts what is left. All counts are combined before the
shuffle, so a value shared by a third of all rows costs one row per task.
Quantiles of whole tables come from sketches and counts (`quantiles`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import written
from .quantiles import quantiles

NO_VALUE = 2**62
# monotonically_increasing_id holds the partition above these bits and the place in it below.
_PLACE_BITS = 33


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by equal keys, a null key being equal to a null key; columns of `left`, then the others of `right`."""
    # `right` keeps its broadcast hint, if it has one.
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def values_at_ranks(
    rows: DataFrame, bucket: Column, ranks: Callable[[Column, Column], Column], groups: Sequence[str] = (),
    bucket_type: str = "bigint", parts: Sequence[Callable[[Column, Column, Column], Column]] = (),
) -> DataFrame:
    """Values at given 1-based ranks, per group: columns groups, target, value, total.

    `rows` holds groups and value. `bucket` is a coarse key of bounded range that
    never decreases with value; `parts` divide a bucket further, from value and
    the smallest and largest value that is left. `ranks` maps a group's row total
    and the largest total of any group to an array of ranks, of fixed length; rank
    0 finds nothing. A null group is a group like any other.
    """
    # Rows without a value go to a bucket of their own, of size 0.
    keyed = rows.withColumn("_bucket", F.coalesce(bucket, F.lit(NO_VALUE).cast(bucket_type)))
    running = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    per_bucket = keyed.groupBy(*groups, "_bucket").agg(
        F.count("value").alias("_size"), F.min("value").alias("_low"), F.max("value").alias("_high")).select(
        *groups, "_bucket", "_size", "_low", "_high",
        (F.sum("_size").over(running) - F.col("_size")).alias("_before"),
        F.sum("_size").over(whole).alias("total"),
    )
    largest = F.max("total").over(Window.partitionBy()) if groups else F.col("total")
    per_bucket = per_bucket.withColumn("_largest", largest)
    local = F.transform(ranks(F.col("total"), F.col("_largest")), lambda rank, i: F.struct(
        i.alias("target"), (rank - F.col("_before")).alias("_local")))
    wanted = per_bucket.select(*groups, "_bucket", "_low", "_high", "total", F.explode(F.filter(
        local, lambda t: (t["_local"] > 0) & (t["_local"] <= F.col("_size")))).alias("_t"))
    wanted = wanted.select(*groups, "_bucket", "_low", "_high", "total", "_t.*")
    # One row per group and rank.
    counted = null_safe_join(keyed, F.broadcast(wanted), [*groups, "_bucket"]).groupBy(
        *groups, "target", "_local", "total", "value").agg(
        F.count("*").alias("_n"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
    inside = counted
    for part in parts:
        # The part that holds the rank: at most as many rows per target as there are parts.
        upto = Window.partitionBy(*groups, "target").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        sizes = inside.withColumn("_part", part(F.col("value"), F.col("_low"), F.col("_high"))).groupBy(
            *groups, "target", "_local", "_part").agg(
            F.sum("_n").alias("_size"), F.min("value").alias("_from"), F.max("value").alias("_to"))
        before = F.col("_reached") - F.col("_size")
        held = sizes.withColumn("_reached", F.sum("_size").over(upto)).where(
            (before < F.col("_local")) & (F.col("_local") <= F.col("_reached"))).select(
            *groups, "target", "_from", "_to", (F.col("_local") - before).alias("_rest"))
        inside = null_safe_join(counted, F.broadcast(held), [*groups, "target"]).where(
            F.col("value").between(F.col("_from"), F.col("_to"))).select(
            *groups, "target", F.col("_rest").alias("_local"), "total", "value", "_n",
            F.col("_from").alias("_low"), F.col("_to").alias("_high"))
    upto = Window.partitionBy(*groups, "target").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("_reached", F.sum("_n").over(upto))
    hit = (F.col("_reached") - F.col("_n") < F.col("_local")) & (F.col("_local") <= F.col("_reached"))
    return reached.where(hit).select(*groups, "target", "value", "total")


def exact_quantiles(df: DataFrame, column: str | Column, probabilities: dict[str, float]) -> DataFrame:
    """One row with the linearly interpolated quantile for each name; nulls are ignored.

    Without any value the row holds nulls. The quantiles are found at once, by two scans.
    """
    found = quantiles(df, {name: (column, share) for name, share in probabilities.items()})
    return df.sparkSession.range(1).select(*[F.lit(value).cast("double").alias(name) for name, value in found.items()])


def with_quantiles(df: DataFrame, column: str | Column, probabilities: dict[str, float]) -> DataFrame:
    """Attach quantiles of a column to every row, as constants."""
    found = quantiles(df, {name: (column, share) for name, share in probabilities.items()})
    return df.withColumns({name: F.lit(value).cast("double") for name, value in found.items()})


def approximate_quantiles(df: DataFrame, column: str, probabilities: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Same shape from one sketch pass, for when a rank error of 1/accuracy will do."""
    names, shares = list(probabilities), list(probabilities.values())
    sketch = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, accuracy).alias("_q"))
    return sketch.select(*[F.col("_q")[i].alias(name) for i, name in enumerate(names)])


QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}


def with_one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (a global aggregate) to every row.

    A scalar subquery: computed once, no join, and it fails should `stats` ever
    hold more than one row.
    """
    row = stats.select(F.struct(*stats.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col("_row")[c].alias(c) for c in stats.columns])


def with_row_index(df: DataFrame, key: str, name: str = "row_index") -> DataFrame:
    """Zero-based position in the order of a key: nulls first, equal keys in the order of a row hash.

    Rows are dealt by ranges of key and hash, so neither sparse keys nor a key
    that a third of all rows share end in one task, and written in order; the
    counts per range give the offsets.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns))
    placed = hashed.repartitionByRange(key, "_hash").sortWithinPartitions(key, "_hash").withColumn(
        "_at", F.monotonically_increasing_id())
    placed = written(placed.drop("_hash"), "numbered")
    part = F.shiftright("_at", _PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # One row per range.
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)).select(*df.columns, name)
