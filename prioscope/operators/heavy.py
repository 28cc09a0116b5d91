"""The most frequent terms without a shuffle of all terms.

Tasks keep summaries of bounded size (Misra and Gries 1982, merged as by Agarwal et
al. 2012): a count per kept term that is too small by at most what was taken off.
Added up, they name candidates, whose exact counts come from a second pass with a
broadcast of the candidates alone. The result is proven: a term that is no
candidate has at most its summary count plus the error, which is less than the last
count of the result; where it is not, there are more candidates, or larger summaries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import written
from .terms import tallies, text_terms, vocabulary

# Terms that a task hands on.
CAPACITY = 100_000
# Candidates that are broadcast; beyond, the summaries grow, and beyond MOST_TERMS all terms are counted.
MOST_CANDIDATES = 200_000
MOST_TERMS = 3_200_000


def summaries(listed: DataFrame, terms: str, capacity: int) -> DataFrame:
    """term and n (occurrences at least) for kept terms, and in the row of a null term the most that any count is short of."""
    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        lost = 0

        def shrunk() -> int:
            """Takes the (capacity + 1)-th largest count off all terms."""
            if len(counts) <= capacity:
                return 0
            values = np.fromiter(counts.values(), np.int64, len(counts))
            cut = int(np.partition(values, -capacity - 1)[-capacity - 1])
            for term in [t for t, n in counts.items() if n <= cut]:
                del counts[term]
            for term in counts:
                counts[term] -= cut
            return cut

        for batch in batches:
            found = batch.column(0).flatten().value_counts()
            counts.update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist())))
            counts.pop(None, None)
            if len(counts) > 2 * capacity:
                lost += shrunk()
        lost += shrunk()
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.string()), pa.array([lost, *counts.values()], pa.int64())],
                                         names=["term", "n"])

    return listed.select(terms).mapInArrow(summarised, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def frequent_terms(df: DataFrame, text: str, size: int, bigrams: bool = True, min_df: int = 2, capacity: int = CAPACITY,
                   most_candidates: int = MOST_CANDIDATES) -> DataFrame:
    """term, occurrences and texts of the `size` most frequent terms in at least `min_df` texts; ties by term.

    Equal to `vocabulary`, from two passes over the texts in place of a shuffle of
    all their terms.
    """
    listed = df.select(text_terms(F.col(text), bigrams).alias("_terms"))
    while capacity <= MOST_TERMS:
        kept = written(summaries(listed, "_terms", capacity), "summaries")
        error = kept.where(F.col("term").isNull()).agg(F.sum("n")).first()[0] or 0
        kept = kept.where(F.col("term").isNotNull())
        least = kept.orderBy(F.desc("n")).limit(size).agg(F.count("*"), F.min("n")).first()
        bound = least[1] if least[0] == size else 1
        # Below the error a term may have left every summary.
        while bound > error:
            candidates = kept.where(F.col("n") + error >= bound).select("term")
            if candidates.limit(most_candidates + 1).count() > most_candidates:
                break
            found = written(_counted(tallies(df, text, bigrams), candidates, min_df).orderBy(F.desc("occurrences"), "term").limit(size), "frequent-terms")
            last = found.agg(F.count("*"), F.min("occurrences")).first()
            reached = last[1] if last[0] == size else 1
            if reached >= bound:
                return found
            bound = reached
        capacity *= 4
    return vocabulary(df, text, size, bigrams, min_df)


def _counted(counts: DataFrame, candidates: DataFrame, min_df: int) -> DataFrame:
    """Exact occurrences and texts of the candidates, which are few enough to be broadcast."""
    return counts.join(F.broadcast(candidates), "term").groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("texts").alias("texts")).where(F.col("texts") >= min_df)
