"""Latent semantic vectors: truncated SVD of a tall sparse matrix as Spark jobs.

Block Krylov iteration from a random start (Musco and Musco, 2015) with a measured
residual. The matrix of texts stays distributed; only term-by-component matrices,
bounded by vocabulary, component count and passes, reach the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import balanced

# The functions below travel to the workers by value: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OVERSAMPLING = 10
# Passes at most, and the residual to stop at.
PASSES = 8
RESIDUAL = 1e-3
# A singular value below this share of the first is numerical noise.
RANK_TOLERANCE = 1e-7
# Rows of a task: each sends back one matrix of sums.
FIT_ROWS = 200_000
# Rows per dense block; a block is at most this many rows times the vocabulary.
BLOCK_ROWS = 512


def _blocks(indices: pa.ListArray, weights: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A batch of sparse rows as small dense blocks over the terms that occur in them.

    Yields the term indices and the block, rows by terms.
    """
    ends = indices.offsets.to_numpy()
    terms, values = indices.values.to_numpy(), weights.values.to_numpy()
    for first in range(0, len(indices), BLOCK_ROWS):
        last = min(first + BLOCK_ROWS, len(indices))
        entries = slice(ends[first], ends[last])
        own = terms[entries]
        known = np.zeros(own.max(initial=-1) + 1, bool)
        known[own] = True
        used, column = np.flatnonzero(known), (np.cumsum(known) - 1)[own]
        block = np.zeros((last - first, len(used)))
        block[np.repeat(np.arange(last - first), np.diff(ends[first:last + 1])), column] = values[entries]
        yield used, block


def _gram_product(df: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """X'(X @ matrix) in one pass over the rows of X.

    Each task sums its own rows; the sums are added term by term in a
    distributed aggregation, and one row per term comes back.
    """
    shared = df.sparkSession.sparkContext.broadcast(matrix)
    width = matrix.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        total = np.zeros_like(basis)
        for batch in batches:
            for terms, block in _blocks(batch.column("indices"), batch.column("weights")):
                total[terms] += block.T @ (block @ basis[terms])
        used = np.flatnonzero(np.any(total != 0, axis=1))
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), sums], ["term", "sums"])

    parts = df.select("indices", "weights").mapInArrow(partial, "term int, sums array<double>")
    added = parts.groupBy("term").agg(*[F.sum(F.col("sums")[j]).alias(f"c{j}") for j in range(width)])
    collected = added.toPandas()
    out = np.zeros_like(matrix)
    out[collected["term"].to_numpy()] = collected.drop(columns="term").to_numpy()
    shared.unpersist()
    return out


@dataclass(frozen=True)
class LatentModel:
    components: np.ndarray       # terms x components, orthonormal columns
    singular_values: np.ndarray

    def vectors(self, indices: Column, weights: Column) -> Column:
        """L2-normalised coordinates of a sparse row, as array<double>."""
        basis = self.components
        width = basis.shape[1]

        @F.arrow_udf("array<double>")
        def project(index_batch: pa.Array, weight_batch: pa.Array) -> pa.Array:
            unit = _coordinates(basis, index_batch, weight_batch)
            return pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), width).cast(pa.list_(pa.float64()))

        return project(indices, weights)

    def reader(self, spark: SparkSession) -> Callable[[Iterator[pa.RecordBatch], int], Iterator[np.ndarray]]:
        """Makes the same coordinates of batches of sparse rows."""
        shared = spark.sparkContext.broadcast(self.components)

        def read(batches: Iterator[pa.RecordBatch], _: int) -> Iterator[np.ndarray]:
            for batch in batches:
                yield _coordinates(shared.value, batch.column("indices"), batch.column("weights"))

        return read


def _coordinates(basis: np.ndarray, indices: pa.ListArray, weights: pa.ListArray) -> np.ndarray:
    parts = [block @ basis[terms] for terms, block in _blocks(indices, weights)]
    products = np.concatenate(parts) if parts else np.zeros((0, basis.shape[1]))
    norms = np.linalg.norm(products, axis=1, keepdims=True)
    return products / np.where(norms == 0, 1.0, norms)


def fit_latent(df: DataFrame, terms: int, k: int = 100, passes: int = PASSES, residual: float = RESIDUAL, seed: int = 42) -> LatentModel:
    """Leading right singular vectors of the rows `indices`, `weights`, which are kept, dealt evenly, during the fit.

    Every pass over the rows adds a block to a Krylov space of X'X, from which the
    best vectors are read (Rayleigh-Ritz). It ends when all of them satisfy
    |X'X v - s^2 v| <= residual * s1^2, or after `passes`; the error of a value is of
    the order of the square of the residual. `k` shrinks to the numerical rank. Sign
    and, for equal singular values, the basis are arbitrary.
    """
    # What does not fit is read again from its table, not kept a second time.
    rows = balanced(df.select("indices", "weights"), FIT_ROWS).persist(StorageLevel.MEMORY_ONLY)
    try:
        return _fitted(rows, terms, k, passes, residual, seed)
    finally:
        rows.unpersist()


def _fitted(rows: DataFrame, terms: int, k: int, passes: int, residual: float, seed: int) -> LatentModel:
    width = min(k + OVERSAMPLING, terms)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    basis, image = np.empty((terms, 0)), np.empty((terms, 0))
    for turn in range(passes):
        basis, image = np.hstack([basis, block]), np.hstack([image, _gram_product(rows, block)])
        small = basis.T @ image
        squares, rotation = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(squares)[::-1][:k]
        squares, rotation = np.maximum(squares[order], 0), rotation[:, order]
        kept = squares > (RANK_TOLERANCE**2) * squares[0]
        vectors = basis @ rotation
        error = np.linalg.norm(image @ rotation - vectors * squares, axis=0)
        if not kept.any() or error[kept].max() <= residual * squares[0] or turn + 1 == passes:
            break
        # What the last product adds to the space; twice, against rounding.
        block = image[:, -block.shape[1]:]
        size = np.linalg.norm(block)
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        left, sizes, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, sizes > 1e-10 * size][:, :terms - basis.shape[1]]
        if not block.shape[1]:
            break
    return LatentModel(vectors[:, kept], np.sqrt(squares[kept]))
