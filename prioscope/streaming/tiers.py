"""Quartile tiers on a stream: sketches of all rows so far, merged batch by batch.

A micro-batch adds up one quantile sketch per group, merges it with the sketches
before it and writes the result as a new version of the state; its rows get their
tier from that version. A version has one row per group, and groups that have not
been seen for `expire` are left out of the next one. Versions and results are
named by batch, so a batch that is repeated after a failure writes what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.severity import resolution_tier
from ..operators.statistics import QUARTILES

# Exact for so many values of a group; beyond, ranks err by about 0.1 % of them.
SKETCH = 4096
MOST_GROUPS = 1000


def merged_sketches(before: DataFrame, rows: DataFrame, minutes: str, group: Column, seen: Column, expire: str | None = None) -> DataFrame:
    """part, sketch, total and seen: the sketches of `before` with the values of `rows` added.

    Null and NaN minutes are no values. Groups whose last row is older than the
    newest of all by more than `expire` (an interval) are left out.
    """
    value = F.nanvl(F.col(minutes).cast("double"), F.lit(None).cast("double"))
    fresh = rows.select(group.cast("string").alias("part"), value.alias("value"), seen.cast("timestamp").alias("seen")).groupBy("part").agg(
        F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"), F.count("value").alias("total"), F.max("seen").alias("seen"))
    both = before.unionByName(fresh).groupBy("part").agg(
        F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"), F.sum("total").alias("total"), F.max("seen").alias("seen"))
    if expire is None:
        return both
    newest = both.agg(F.max("seen").alias("seen")).scalar()
    return both.where(F.col("seen").isNull() | (F.col("seen") >= newest - F.expr(f"INTERVAL {expire}")))


def with_sketch_cuts(rows: DataFrame, sketches: DataFrame, group: Column) -> DataFrame:
    """Rows with p25, p50 and p75 of their group, linearly interpolated; null for a group without values.

    The ranks to look up are constants of a sketch function, so there is a case for
    every size of a group; more than MOST_GROUPS raise.
    """
    totals = sorted({r["total"] for r in sketches.where("total > 0").select("total").distinct().limit(MOST_GROUPS + 1).collect()})
    if len(totals) > MOST_GROUPS:
        raise ValueError(f"groups of more than {MOST_GROUPS} sizes")
    found = F.lit(None).cast("array<double>")
    for total in totals:
        ranks = [min(total, int((total - 1) * share) + i) for share in QUARTILES.values() for i in (1, 2)]
        # Half a rank below the end of the value's own, against rounding.
        points = F.array(*[F.lit((rank - 0.5) / total) for rank in ranks])
        found = F.when(F.col("total") == total, F.kll_sketch_get_quantile_double(F.col("sketch"), points)).otherwise(found)
    values = sketches.select(F.col("part").alias("_part"), "total", found.alias("_at"))
    cuts = []
    for i, (name, share) in enumerate(QUARTILES.items()):
        low, high = F.col("_at")[2 * i], F.col("_at")[2 * i + 1]
        spot = (F.col("total") - 1) * share
        cuts.append(F.when(low == high, low).otherwise(low + (high - low) * (spot - F.floor(spot))).alias(name))
    # One row per group; the rows of a batch need not be spread by it.
    return rows.withColumn("_own", group.cast("string")).join(
        values.select("_part", *cuts), F.col("_own").eqNullSafe(F.col("_part")), "left").drop("_own", "_part")


def tier_stream(stream: DataFrame, output: str, checkpoint: str, minutes: str = "resolution_minutes", group: str | None = None,
                time: str | None = None, expire: str | None = None) -> StreamingQuery:
    """Adds p25, p50, p75 and resolution_tier to arriving rows by the quartiles of all rows of their group so far.

    Results are the Parquet folders `output`/batch=N, state versions stand in
    `checkpoint`/sketches. Processes what has arrived and stops; a restart
    continues from the checkpoint.
    """
    spark = stream.sparkSession
    own = F.lit("all") if group is None else F.col(group)
    seen = F.lit(None) if time is None else F.col(time)
    schema = "part string, sketch binary, total bigint, seen timestamp"

    def arrived(batch: DataFrame, number: int) -> None:
        before = _version(spark, checkpoint, number - 1, schema)
        path = f"{checkpoint}/sketches/batch={number}"
        merged_sketches(before, batch, minutes, own, seen, expire).write.mode("overwrite").parquet(path)
        cut = with_sketch_cuts(batch, spark.read.parquet(path), own)
        tier = resolution_tier(F.col(minutes), F.col("p25"), F.col("p50"), F.col("p75"))
        cut.withColumn("resolution_tier", tier).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(arrived).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def _version(spark: SparkSession, checkpoint: str, number: int, schema: str | StructType) -> DataFrame:
    if number < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{checkpoint}/sketches/batch={number}")
