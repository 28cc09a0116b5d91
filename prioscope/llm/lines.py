"""Line dedup: lines that many sites share are boilerplate and go.

A HyperLogLog sketch of the sites of each line hash, merged by aggregation,
settles all lines but those near the threshold; those get an exact distinct
count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import written
from .common import column, packed, unpacked

MIN_SITES = 10
LOG_SKETCH = 12


def site_spread(lines: DataFrame, min_sites: int = MIN_SITES, log_sketch: int = LOG_SKETCH) -> DataFrame:
    """Hashes of the lines seen on at least `min_sites` different sites.

    `lines` has line_hash and site; a null site is none. Sketches of 2^log_sketch
    registers err by 1.04 / sqrt(2^log_sketch); estimates within four times that
    of the threshold, and at least within one site of it, are counted exactly.
    """
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(1 << log_sketch) * min_sites))
    sketched = written(lines.groupBy("line_hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_sketch))).alias("sites"))
        .where(F.col("sites") >= min_sites - band), "spread")
    sure = sketched.where(F.col("sites") > min_sites + band).select("line_hash")
    near = sketched.where(F.col("sites") <= min_sites + band).select("line_hash")
    exact = lines.where(F.col("site").isNotNull()).join(near, "line_hash").select("line_hash", "site").distinct().groupBy(
        "line_hash").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(exact.select("line_hash"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source",
                     log_sketch: int = LOG_SKETCH) -> DataFrame:
    """All rows and columns of `docs`, plus n_lines, n_removed and kept_text.

    Lines are the parts between line feeds, whole; lines of spaces and tabs only
    are never removed. Null text: no lines, empty kept_text. Equal lines count
    alike wherever they stand; repeated rows get equal results. Columns of
    `docs` with the added names are replaced.
    """
    rows = docs.select(packed(docs), column(text).alias("text"), column(site).cast("string").alias("site"))
    # What is removed depends on the text alone, so copies share a key.
    rows = rows.withColumn("key", F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b")))
    parts = rows.where(F.col("text").isNotNull()).select("key", "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = written(parts.where(F.regexp_like("line", F.lit("[^ \\t]"))).select(
        "key", "site", "place", F.xxhash64("line").alias("line_hash")), "lines")
    removed = lines.join(site_spread(lines.select("line_hash", "site"), min_sites, log_sketch), "line_hash").groupBy(
        "key").agg(F.collect_set("place").alias("gone"))
    none = F.array().cast("array<int>")
    joined = rows.join(removed, "key", "left").withColumns({
        "gone": F.coalesce("gone", none),
        "all_lines": F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n")),
    })
    kept = F.filter("all_lines", lambda line, i: ~F.array_contains("gone", i))
    return joined.withColumns({
        "n_lines": F.size("all_lines").cast("bigint"), "n_removed": F.size("gone").cast("bigint"),
        "kept_text": F.array_join(kept, "\n"),
    }).select(*unpacked(docs.columns, ["n_lines", "n_removed", "kept_text"]))
