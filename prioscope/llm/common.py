"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of `df` as one struct, so that columns an operator adds cannot clash with them."""
    return F.struct(*[column(c).alias(c) for c in df.columns]).alias(name)


def unpacked(columns: list[str], added: list[str], row: str = "row") -> list[Column]:
    """The packed columns again, without those that an added column of the same name replaces."""
    return [F.col(row).getField(c).alias(c) for c in columns if c not in added] + [F.col(c) for c in added]


def connected_components(edges: DataFrame) -> DataFrame:
    """Node and component (its smallest node) for every node of `edges` (u, v: bigint).

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    step hangs the neighbours of a node on their smallest member, until all
    components are stars. Each round is a written table, so a lost executor
    costs no earlier round. A node with very many links is pre-aggregated to its
    minimum and its rows are joined by a plain join that adaptive execution
    splits. Null ends and self links are ignored; an empty table gives none.
    """
    links = written(
        edges.where(F.col("u") != F.col("v")).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _fingerprint(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        heads = both.groupBy("u").agg(F.min("v").alias("_low")).select("u", F.least("u", "_low").alias("head"))
        large = (both.where(F.col("v") > F.col("u")).join(heads, "u")
                 .select(F.col("v").alias("u"), F.col("head").alias("v")).distinct())
        large = written(large, "large-star")
        lows = large.groupBy("u").agg(F.min("v").alias("head"))
        joined = large.join(lows, "u")
        small = joined.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("head").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("head").alias("v")),
        )).alias("e")).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        links = written(small, "small-star")
        before, mark = mark, _fingerprint(links)
        if mark == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _fingerprint(links: DataFrame) -> tuple:
    """Rows and an order-free checksum: two numbers, whatever the size."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
