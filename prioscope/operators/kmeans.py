"""k-means with many restarts in one pass per iteration.

Points are packed into blocks of bytes, a table that every pass scans once. A pass
takes the distances of a block to the centres of all restarts from one matrix
product and sends back sums per restart and cluster. Restarts that have converged
leave the product. Bounds per point (Hamerly, Elkan) would save part of that product
but need a table of point states rewritten by every pass; with a few clusters the
scan is what a pass costs. Where blocks would take much room, a pass makes its points
anew from rows that are kept in a smaller form (fit_points).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import balanced, written

# Makes points, rows by dimensions, of batches of rows and the number of dimensions.
Reader = Callable[[Iterator[pa.RecordBatch], int], Iterator[np.ndarray]]

# Points of a block.
BLOCK = 4096
# Rounds of seeding, and points drawn in each per wanted cluster (k-means||, Bahmani et al. 2012).
SEEDING_ROUNDS = 3
OVERSAMPLING = 2
# Centres stop when they move by less than this share of the mean variance of a coordinate.
TOLERANCE = 1e-6
# Blocks of a task: each sends back one matrix of sums.
FIT_BLOCKS = 50


@dataclass(frozen=True)
class Clusters:
    centres: np.ndarray     # clusters x dimensions
    cost: float             # sum of squared distances
    costs: tuple[float, ...]  # of every restart

    def nearest(self, vector: Column) -> Column:
        """Number of the nearest centre, the smaller one of a tie; null for a null vector."""
        centres = self.centres

        @F.arrow_udf("int")
        def assign(batch: pa.Array) -> pa.Array:
            known = batch.drop_null()
            points = known.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, centres.shape[1])
            out = np.zeros(len(batch), np.int32)
            out[batch.is_valid().to_numpy(zero_copy_only=False)] = _squares(points, centres).argmin(axis=1)
            return pa.array(out, mask=batch.is_null().to_numpy(zero_copy_only=False))

        return assign(vector)


def fit_kmeans(df: DataFrame, vector: str, k: int, seeds: Sequence[int], max_iter: int, tolerance: float = TOLERANCE) -> Clusters:
    """The clusters of the restart with the smallest cost, the first of equal ones; one restart per seed.

    `vector` is an array of doubles; null vectors do not count, vectors of
    different lengths raise. Fewer different points than clusters leave centres
    that coincide. Without any point the centres are a matrix without columns.
    """
    blocks, dims, variance = _packed(df, vector)
    if dims is None:
        return Clusters(np.zeros((k, 0)), 0.0, tuple(0.0 for _ in seeds))
    # What does not fit is read again from its table, not kept a second time.
    blocks = blocks.persist(StorageLevel.MEMORY_ONLY)
    try:
        return _fitted(blocks, dims, variance, k, seeds, max_iter, tolerance)
    finally:
        blocks.unpersist()


def fit_points(rows: DataFrame, read: Reader, dims: int, k: int, seeds: Sequence[int], max_iter: int, tolerance: float = TOLERANCE) -> Clusters:
    """fit_kmeans of the points that `read` makes of batches of rows, in every pass; they are not kept."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, 0.0, 0.0
        for points in read(batches, dims):
            n, total, squares = n + len(points), total + float(points.sum()), squares + float((points * points).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total]), pa.array([squares])], names=["n", "total", "squares"])

    found = rows.mapInArrow(moments, "n bigint, total double, squares double").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).first()
    if not found["n"]:
        return Clusters(np.zeros((k, 0)), 0.0, tuple(0.0 for _ in seeds))
    cells = found["n"] * max(1, dims)
    variance = max(found["squares"] / cells - (found["total"] / cells) ** 2, 1e-300)
    return _fitted(rows, dims, variance, k, seeds, max_iter, tolerance, read)


def _points(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for data in batch.column(0):
            yield np.frombuffer(data.as_buffer(), float).reshape(-1, dims)


def _fitted(blocks: DataFrame, dims: int, variance: float, k: int, seeds: Sequence[int], max_iter: int, tolerance: float,
            read: Reader = _points) -> Clusters:
    centres = _seeded(blocks, k, seeds, dims, read)
    active = list(range(len(seeds)))
    for _ in range(max_iter):
        counts, sums, _ = _pass(blocks, centres[active], dims, read)
        moved = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], centres[active])
        if (counts == 0).any():
            _repair(blocks, moved, counts, centres[active], read)
        shift = ((moved - centres[active]) ** 2).sum(axis=(1, 2))
        centres[active] = moved
        active = [r for r, s in zip(active, shift) if s > tolerance * variance]
        if not active:
            break
    costs = _pass(blocks, centres, dims, read)[2]
    best = int(costs.argmin())
    return Clusters(centres[best], float(costs[best]), tuple(costs.tolist()))


def _packed(df: DataFrame, vector: str) -> tuple[DataFrame, int | None, float]:
    """Blocks of points (data: bytes of doubles), their dimensions and the mean variance of a coordinate."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            if len(np.unique(sizes)) > 1:
                raise ValueError("vectors of different lengths")
            points = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)
            parts = [points[at:at + BLOCK] for at in range(0, len(points), BLOCK)]
            yield pa.RecordBatch.from_arrays([
                pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([p.shape[1] for p in parts], pa.int32()),
                pa.array([len(p) for p in parts], pa.int64()), pa.array([float(p.sum()) for p in parts]),
                pa.array([float((p * p).sum()) for p in parts]),
                pa.array([float((p.sum(axis=0) ** 2).sum()) for p in parts])], names=["data", "dims", "n", "total", "squares", "spread"])

    kept = balanced(df.select(vector)).where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>"))
    blocks = written(kept.mapInArrow(pack, "data binary, dims int, n bigint, total double, squares double, spread double"), "points")
    found = blocks.agg(F.min("dims").alias("low"), F.max("dims").alias("high"), F.sum("n").alias("n"), F.sum("total").alias("total"),
                       F.sum("squares").alias("squares")).first()
    if not found["n"]:
        return blocks, None, 0.0
    if found["low"] != found["high"]:
        raise ValueError("vectors of different lengths")
    cells = found["n"] * max(1, found["high"])
    variance = max(found["squares"] / cells - (found["total"] / cells) ** 2, 1e-300)
    return balanced(blocks.select("data"), FIT_BLOCKS), found["high"], variance


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points x centres."""
    out = (points * points).sum(axis=1)[:, None] - 2 * (points @ centres.T) + (centres * centres).sum(axis=1)
    return np.maximum(out, 0)


def _shared(blocks: DataFrame, work: Callable, schema: str, payload: object) -> DataFrame:
    known = blocks.sparkSession.sparkContext.broadcast(payload)
    return blocks.mapInArrow(lambda batches: work(batches, known.value), schema)


def _pass(blocks: DataFrame, centres: np.ndarray, dims: int, read: Reader = _points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per restart and cluster the points and their sums, per restart the cost; centres are restarts x clusters x dimensions."""
    restarts, k, _ = centres.shape

    def work(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = centres.reshape(restarts * k, dims)
        sums, counts, cost = np.zeros((restarts * k, dims)), np.zeros(restarts * k), np.zeros(restarts)
        for points in read(batches, dims):
            squares = _squares(points, flat).reshape(len(points), restarts, k)
            nearest = squares.argmin(axis=2)
            cost += squares.min(axis=2).sum(axis=0)
            member = (nearest[:, :, None] == np.arange(k)).reshape(len(points), restarts * k).astype(float)
            sums += member.T @ points
            counts += member.sum(axis=0)
        rows = np.hstack([np.repeat(cost, k)[:, None], counts[:, None], sums])
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), dims + 2).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(restarts * k, dtype=np.int32)), values], names=["at", "row"])

    parts = _shared(blocks, work, "at int, row array<double>", centres)
    added = parts.groupBy("at").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(dims + 2)]).toPandas().set_index("at").sort_index()
    table = added.to_numpy().reshape(restarts, k, dims + 2)
    return table[:, :, 1], table[:, :, 2:], table[:, 0, 0]


def _drawn(blocks: DataFrame, centres: list[np.ndarray], dims: int, number: int, seeds: Sequence[int] | None, turn: int = 0,
           read: Reader = _points) -> list[np.ndarray]:
    """Per restart `number` points: drawn in proportion to their squared distance from its centres, or the farthest without seeds.

    A draw keeps the points with the largest keys u^(1/weight) (Efraimidis and
    Spirakis 2006), so tasks hand on `number` points each.
    """
    def work(batches: Iterator[pa.RecordBatch], centres: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros((0, dims))) for _ in centres]
        for points in read(batches, dims):
            mark = int(np.bitwise_xor.reduce(points.ravel().view(np.uint64), initial=np.uint64(0)))
            for r, own in enumerate(centres):
                weight = _squares(points, own).min(axis=1) if len(own) else np.ones(len(points))
                keys = weight
                if seeds is not None:
                    draw = np.random.default_rng([seeds[r] % 2**32, turn, mark % 2**32, mark >> 32]).random(len(points))
                    keys = np.where(weight > 0, np.log(draw) / np.where(weight > 0, weight, 1), -np.inf)
                known, kept = np.append(best[r][0], keys), np.vstack([best[r][1], points])
                top = np.argsort(-known, kind="stable")[:number]
                best[r] = known[top], kept[top]
        rows = [(r, float(key), point) for r, (keys, points) in enumerate(best) for key, point in zip(keys, points)]
        yield pa.RecordBatch.from_arrays([
            pa.array([r for r, _, _ in rows], pa.int32()), pa.array([key for _, key, _ in rows], pa.float64()),
            pa.array([point for _, _, point in rows], pa.list_(pa.float64()))], names=["restart", "key", "point"])

    found = _shared(blocks, work, "restart int, key double, point array<double>", centres).toPandas()
    out = []
    for r in range(len(centres)):
        own = found[found["restart"] == r].sort_values("key", ascending=False, kind="stable").head(number)
        out.append(np.array(own["point"].tolist(), float).reshape(-1, dims))
    return out


def _weights(blocks: DataFrame, candidates: list[np.ndarray], dims: int, read: Reader) -> list[np.ndarray]:
    """Per restart the points nearest to each candidate."""
    def work(batches: Iterator[pa.RecordBatch], candidates: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(own)) for own in candidates]
        for points in read(batches, dims):
            for count, own in zip(counts, candidates):
                count += np.bincount(_squares(points, own).argmin(axis=1), minlength=len(own))
        flat = np.concatenate(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "n"])

    added = _shared(blocks, work, "at int, n double", candidates).groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = added.sort_values("at")["n"].to_numpy()
    return np.split(flat, np.cumsum([len(own) for own in candidates])[:-1])


def _seeded(blocks: DataFrame, k: int, seeds: Sequence[int], dims: int, read: Reader) -> np.ndarray:
    """First centres of every restart: k-means|| candidates, reduced by weighted k-means++."""
    candidates = _drawn(blocks, [np.zeros((0, dims))] * len(seeds), dims, 1, seeds, read=read)
    for turn in range(1, SEEDING_ROUNDS + 1):
        more = _drawn(blocks, candidates, dims, OVERSAMPLING * k, seeds, turn, read)
        candidates = [np.vstack(pair) for pair in zip(candidates, more)]
    out = np.empty((len(seeds), k, dims))
    for r, (points, weights) in enumerate(zip(candidates, _weights(blocks, candidates, dims, read))):
        draw = np.random.default_rng(seeds[r])
        chosen = [int(draw.choice(len(points), p=weights / weights.sum()))]
        while len(chosen) < k:
            far = weights * _squares(points, points[chosen]).min(axis=1)
            chosen.append(int(draw.choice(len(points), p=far / far.sum())) if far.sum() > 0 else chosen[0])
        out[r] = points[chosen]
    return out


def _repair(blocks: DataFrame, moved: np.ndarray, counts: np.ndarray, centres: np.ndarray, read: Reader = _points) -> None:
    """Centres without points move to the points that are farthest from all centres."""
    dims = centres.shape[2]
    far = _drawn(blocks, list(centres), dims, centres.shape[1], None, read=read)
    for r in range(len(moved)):
        empty = np.flatnonzero(counts[r] == 0)
        for at, point in zip(empty, far[r]):
            if _squares(point[None], moved[r]).min() > 0:
                moved[r, at] = point
