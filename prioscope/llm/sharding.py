"""Sharding: a uniformly random order of all records by a two-pass external shuffle, dealt to shards.

Pass one scatters the records into buckets by seeded hashes, so many that one
bucket fits in memory. Pass two puts each bucket in random order (Fisher-Yates,
as `shuffle` does it) and writes it. The position of a record in the
whole order is the number of records in earlier buckets plus its place in its
own; dealing positions round-robin makes shard counts at most one apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import written
from .common import column, packed, unpacked

SHARDS = 24
BUCKET_BYTES = 4 << 20
# The offset table has one row per bucket and is broadcast: at most 4,194,304 rows (about 100 MB). Beyond 16 TB buckets grow instead.
MAX_BUCKETS = 1 << 22
# Tasks of the second pass; beyond so many buckets a task takes several, one after the other.
MAX_TASKS = 1 << 16
RECORD_OVERHEAD = 8


def record_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus eight."""
    return (F.coalesce(F.octet_length(column(text)), F.lit(0)) + RECORD_OVERHEAD).cast("bigint")


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = 17, text: str = "text",
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of `docs` plus `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    `docs` should be a table at rest: a row's bucket comes from a hash of the
    seed and its place in the table, so that repeated rows and a hot key spread
    like any others. Rows with null or very long text are records like the rest;
    a text larger than a bucket makes that bucket larger. Columns of `docs` named
    shard or slot are replaced. An empty table gives no rows.
    """
    total = docs.agg(F.sum(record_bytes(text))).first()[0] or 0
    buckets = max(1, math.ceil(total / max(bucket_bytes, total / MAX_BUCKETS)))
    place = F.monotonically_increasing_id()
    scattered = docs.select(place.alias("place"), packed(docs)).select(
        F.pmod(F.xxhash64(F.lit(seed), F.col("place")), F.lit(buckets)).cast("int").alias("bucket"),
        F.xxhash64(F.lit(seed + 1), F.col("place")).alias("place"), "row")
    # Sorted before they are shuffled, buckets of a task too: the draw depends on the seed, not on the order of arrival.
    # Rows are compared by place alone: they may hold columns that have no order.
    by_place = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
    grouped = scattered.repartition(min(buckets, MAX_TASKS), "bucket").groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("place", "row")), by_place).alias("records")).sortWithinPartitions("bucket")
    shuffled = grouped.select("bucket", F.shuffle("records", seed).alias("records"))
    stage = written(shuffled.select("bucket", F.posexplode("records").alias("place", "record"))
                    .select("bucket", "place", "record.row"), "shuffled")
    position = F.col("before") + F.col("place")
    return stage.join(F.broadcast(_offsets(stage)), "bucket").withColumns({
        "shard": (position % shards).cast("int"), "slot": F.floor(position / shards).cast("bigint"),
    }).select(*unpacked(docs.columns, ["shard", "slot"]))


def _offsets(stage: DataFrame) -> DataFrame:
    """Records in earlier buckets, per bucket: sums of runs of 512 buckets first, so that no task sees all buckets."""
    counts = stage.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / 512))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n").alias("n")).select(
        "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(runs, "run").select(
        "bucket", (F.col("base") + F.col("within")).alias("before"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard, records in slot order inside each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
