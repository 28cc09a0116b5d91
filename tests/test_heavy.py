"""The most frequent terms from summaries equal those from all counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prioscope.operators.heavy import frequent_terms, summaries
from prioscope.operators.terms import text_terms, vocabulary


@pytest.fixture(scope="module")
def texts(spark):
    draw = np.random.default_rng(4)
    words = [f"w{i:03}" for i in range(400)]
    share = 1 / np.arange(1, 401) ** 1.3
    rows = [(i, " ".join(draw.choice(words, draw.integers(0, 60), p=share / share.sum()))) for i in range(400)]
    rows += [(900, " ".join(["often"] * 500)), (901, None), (902, ""), (903, "tie one tie two")]
    return spark.createDataFrame(rows, "id int, text string").repartition(4).cache()


@pytest.mark.parametrize("size,capacity,most", [(20, 60, 200_000), (20, 100_000, 200_000), (5000, 500, 200_000), (50, 200, 30)])
def test_frequent_terms(texts, size, capacity, most):
    """Small summaries lose counts, few candidates are not enough, and a text with many repeats of one word does not count."""
    expected = [tuple(r) for r in vocabulary(texts, "text", size).collect()]
    got = [tuple(r) for r in frequent_terms(texts, "text", size, capacity=capacity, most_candidates=most).collect()]
    assert sorted(got) == sorted(expected) and ("often", 500, 1) not in got


def test_summaries_bound_their_error(texts):
    listed = texts.select(text_terms(F.col("text")).alias("_terms"))
    exact = {r["t"]: r["count"] for r in listed.select(F.explode("_terms").alias("t")).groupBy("t").count().collect()}
    found = {r["term"]: r["n"] for r in summaries(listed, "_terms", 50).collect()}
    error = found.pop(None)
    assert error > 0 and len(found) <= 4 * 50
    assert all(n <= exact[t] for t, n in found.items())
    assert all(exact[t] - found.get(t, 0) <= error for t in exact)


def test_no_texts(texts):
    assert frequent_terms(texts.limit(0), "text", 5).count() == 0
