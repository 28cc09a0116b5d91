"""Top-k by inner product against all products."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prioscope.llm import products

SCHEMA = "vec_id bigint, embedding array<double>, score string"


def brute(rows, asked, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, [math.floor(256 * x) for x in v])
    out = []
    for q in asked:
        if q in good:
            hits = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits[:k])]
    return sorted(out)


def vectors(n, dim, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    return [(centres[draw.integers(6)] * draw.uniform(0.2, 2) + draw.normal(size=dim) * 0.1).tolist() for _ in range(n)]


@pytest.mark.parametrize("tree", [40, 8192])
def test_top_products(spark, tree):
    rows = list(enumerate(vectors(400, 8, 1)))
    rows += [(1000 + i, rows[7][1]) for i in range(60)]                      # a crowd of equal vectors
    rows += [(2000 + i, [float(i % 3)] * 3) for i in range(4)]               # fewer of this length than asked for
    rows += [(3000, None), (3001, [None] * 8), (3002, [float("nan")] * 8), (3003, [float("inf")] * 8), (None, rows[0][1]),
             (3004, [0.0] * 8), (3005, []), (3006, [1e300] * 8)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + rows[:50]], SCHEMA).withColumn("m", F.create_map("score", "score"))
    got = sorted(tuple(r) for r in products.top_products(df.repartition(5), F.col("vec_id") % 20 == 0, k=6, tree=tree).collect())
    assert got == brute([r for r in rows if r[0] != 3006], [i for i, _ in rows if i is not None and i % 20 == 0], 6)


def test_nothing_to_search(spark):
    df = spark.createDataFrame([(1, [1.0], "x")], SCHEMA)
    assert products.top_products(df, F.col("vec_id") == 1).count() == 0
    assert products.top_products(df, F.col("vec_id") == 5).count() == 0
    assert products.top_products(df.limit(0), F.col("vec_id") == 1).columns == ["query_id", "rank", "vec_id", "score"]
    assert products.top_products(df.limit(0), F.col("vec_id") == 1).count() == 0


@pytest.mark.parametrize("scale", [256, 2**26])
def test_tree_is_exact_and_passes_entries_over(scale):
    ints = np.floor(np.array(vectors(1500, 6, 4)) * scale).astype(int)
    largest = int((ints * ints).sum(axis=1).max())
    block = pa.table({"v": pa.array(ints.tolist(), pa.list_(pa.int32())), "ids": pa.array([[i] for i in range(1500)], pa.list_(pa.int64())),
                      "dim": pa.array([6] * 1500, pa.int32()), "cell": pa.array([0] * 1500, pa.int32()), "block": pa.array([0] * 1500)})
    pages = products._Builder(largest).build(block)
    assert pages["page"].to_pylist() == list(range(len(pages)))
    assert max(len(r) for r in pages["radii"].to_pylist()) <= products.PAGE
    tree = products.MTree(pages, largest)
    asked = list(range(0, 1500, 50))
    got = tree.search(ints[asked].astype(float), asked, np.full(len(asked), -np.inf), 5)
    for q, hits in zip(asked, got):
        scores = [int(sum(int(a) * int(b) for a, b in zip(ints[q], v))) for v in ints]
        assert hits == sorted(((s, i) for i, s in enumerate(scores) if i != q), key=lambda h: (-h[0], h[1]))[:5]
    alone = products.MTree(pages, largest)
    alone.search(ints[:1].astype(float), [0], np.full(1, -np.inf), 5)
    assert alone.avoided > 0 and alone.computed < 1500
