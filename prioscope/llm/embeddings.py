"""Embedding near-duplicates: an exact metric range join over pivot cells.

Cosine at least c between vectors is distance at most r = sqrt(2 - 2c) between
their directions. Each vector lives in the cell of its nearest pivot and is
copied to every other cell that could hold a neighbour of it: by the triangle
inequality a neighbour that lives at pivot q satisfies d(v, q) <= d(v, home) + 2r,
and v lies within r of the plane halfway between the two pivots. So all
neighbours of a vector are in its own cell, and cells are joined on their own, in
blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import written
from .common import column, connected_components

COSINE = 0.98
# One pivot for so many different vectors, at most MAX_PIVOTS (they are broadcast).
PER_PIVOT = 512
MAX_PIVOTS = 4096
BLOCK = 256
_SLACK = 1e-9


def embedding_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                         cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """key, n_links, component_id and kept for every row of `vectors`.

    Only vectors with equal labels and dimensions are compared. Rows with a null
    key or label, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing: no links, component_id is the
    key. Equal vectors are compared once and count as often as they occur;
    n_links counts rows. An empty table gives none.
    """
    rows = vectors.select(column(key).alias("key"), column(vector).alias("vector"), column(label).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("key").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    classes = written(rows.where(usable).groupBy("label", "vector").agg(
        F.min("key").alias("id"), F.count("*").alias("n")), "vector-classes")
    found = written(_range_join(classes, cosine, block), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("u"), F.col("head").alias("v"))).withColumnRenamed("node", "id")
    of_class = classes.join(links, "id", "left").join(parts, "id", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    joined = rows.withColumn("usable", usable).join(
        of_class.withColumn("usable", F.lit(True)), ["usable", "label", "vector"], "left")
    own = F.coalesce("component_id", "key")
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         own.alias("component_id"), F.coalesce(F.col("key") == own, F.lit(False)).alias("kept"))


def _range_join(classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """id, links, head: per block pair the links of a vector at home there, and the smallest id of its linked group."""
    wanted = min(MAX_PIVOTS, classes.count() // PER_PIVOT)
    pivots: dict[tuple, list] = {}
    for r in classes.orderBy(F.xxhash64("id"), "id").limit(wanted).select("label", "vector").collect():
        pivots.setdefault((r["label"], len(r["vector"])), []).append(r["vector"])
    units = {k: _units(np.array(v, float)) for k, v in pivots.items()}
    offsets, at = {}, 0
    for k in units:
        offsets[k], at = at, at + len(units[k])
    known = classes.sparkSession.sparkContext.broadcast((units, offsets))
    radius = math.sqrt(2 - 2 * cosine)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, offsets = known.value
        for batch in batches:
            labels, arrays = batch.column(1).to_pylist(), batch.column(2)
            sizes = np.diff(arrays.offsets.to_numpy())
            take, cells, homes = [], [], []
            groups: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(labels, sizes.tolist())):
                groups.setdefault(group, []).append(i)
            for group, members in groups.items():
                if group not in units:  # no pivot among these: one cell
                    take.append(np.array(members)), cells.append(np.full(len(members), -1)), homes.append(np.ones(len(members), bool))
                    continue
                picked = arrays.take(pa.array(members))
                own = _units(picked.values.to_numpy(zero_copy_only=False).astype(float)[
                    picked.offsets[0].as_py():picked.offsets[-1].as_py()].reshape(len(members), group[1]))
                at_pivots = units[group]
                square = np.maximum(2 - 2 * own @ at_pivots.T, 0)
                home = square.argmin(axis=1)
                nearest = square[np.arange(len(own)), home][:, None]
                between = np.sqrt(np.maximum(2 - 2 * at_pivots @ at_pivots.T, 0))[home]
                copied = (np.sqrt(square) <= np.sqrt(nearest) + 2 * radius + _SLACK) & (
                    square - nearest <= 2 * between * radius + _SLACK)
                row, cell = np.nonzero(copied)
                take.append(np.array(members)[row])
                cells.append(cell + offsets[group])
                homes.append(cell == home[row])
            rows = batch.take(pa.array(np.concatenate(take)))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(homes))],
                names=[*batch.schema.names, "cell", "home"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    inputs = classes.select("id", "label", "vector", "n")
    schema = ", ".join(f"{c} {kinds[c]}" for c in inputs.columns) + ", cell int, home boolean"
    placed = written(inputs.mapInArrow(assign, schema), "cells")
    cell = ["label", "dim", "cell"]
    placed = placed.withColumn("dim", F.size("vector"))
    counts = placed.groupBy(*cell).agg(F.ceil(F.count("*") / block).alias("all_blocks"),
                                       F.ceil(F.count_if("home") / block).alias("home_blocks"))
    sized = placed.join(counts, cell).where("home_blocks > 0")
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col(n))
    seekers = sized.where("home").select("id", "vector", "n", *cell, F.lit(True).alias("seeks"),
                                         own("home_blocks", 1).alias("a"), F.explode(every("all_blocks")).alias("b"))
    others = sized.select("id", "vector", "n", *cell, F.lit(False).alias("seeks"),
                          F.explode(every("home_blocks")).alias("a"), own("all_blocks", 2).alias("b"))

    def join(table: pa.Table) -> pa.Table:
        seeks = table["seeks"].to_numpy()
        ids, n = table["id"].to_numpy(), table["n"].to_numpy()
        data = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        data = _scaled(data)
        norm = np.sqrt((data * data).sum(axis=1))
        linked = (data[seeks] @ data[~seeks].T) / np.outer(norm[seeks], norm[~seeks]) >= cosine
        linked &= ids[seeks][:, None] != ids[~seeks][None, :]
        rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        linked = linked[np.ix_(rows, cols)]
        left, right = ids[seeks][rows], ids[~seeks][cols]
        links = linked @ n[~seeks][cols]
        # Smallest id of each linked group: the labels of both sides pass along the links until none changes.
        big = np.iinfo(np.int64).max
        low, high = left.copy(), right.copy()
        while len(rows):
            before = (low.copy(), high.copy())
            low = np.minimum(low, np.where(linked, high[None, :], big).min(axis=1))
            high = np.minimum(high, np.where(linked, low[:, None], big).min(axis=0))
            if (low == before[0]).all() and (high == before[1]).all():
                break
        return pa.table({"id": pa.array(np.concatenate([left, right]), pa.int64()),
                         "links": pa.array(np.concatenate([links, np.zeros(len(right), np.int64)]), pa.int64()),
                         "head": pa.array(np.concatenate([low, high]), pa.int64())})

    return seekers.unionByName(others).groupBy(*cell, "a", "b").applyInArrow(join, "id bigint, links bigint, head bigint")


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Divided by a power of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
