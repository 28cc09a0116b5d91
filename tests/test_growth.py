"""Work is dealt by the number of rows, and counted by the batch."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prioscope.operators import features, latent, margin, terms
from prioscope.sources import composed
from prioscope.sources.tables import balanced, written


def partitions(df):
    return df.rdd.getNumPartitions()


def test_few_files_are_dealt_over_the_cores(spark):
    """100,000 rows in one small file were one task."""
    table = written(spark.range(100_000).coalesce(1), "few")
    assert partitions(table) == 1 and partitions(balanced(table)) == 8
    assert partitions(balanced(table, 1_000)) == 100
    assert sorted(r.id for r in balanced(table, 1_000).collect()) == list(range(100_000))
    assert partitions(balanced(table.limit(0))) == partitions(table.limit(0))


def test_spread_goes_by_rows(spark, monkeypatch):
    monkeypatch.setattr(composed, "TASK_ROWS", 1_000)
    table = written(spark.range(30_500).repartition(8), "many")
    assert partitions(composed.spread(table, "id")) == 31
    assert partitions(composed.spread(table.limit(5), "id")) == 8


def test_fits_deal_their_rows(spark, monkeypatch):
    """Passes of the SVD and of the margin classifier had a fixed number of tasks."""
    seen = []
    monkeypatch.setattr(latent, "FIT_ROWS", 300)
    step = latent._gram_product
    monkeypatch.setattr(latent, "_gram_product", lambda rows, block: seen.append(partitions(rows)) or step(rows, block))
    draw = np.random.default_rng(3)
    rows = [([0, 1, 2], draw.normal(size=3).tolist()) for _ in range(9_000)]
    df = written(spark.createDataFrame(rows, "indices array<int>, weights array<double>").coalesce(1), "weights")
    found = latent.fit_latent(df, 3, 2)
    assert set(seen) == {30}
    exact = np.linalg.svd(np.array([w for _, w in rows]))[1][:2]
    assert found.singular_values == pytest.approx(exact, rel=1e-6)
    monkeypatch.setattr(margin, "FIT_BLOCKS", 1)
    made = []
    passes = margin._Passes.__init__
    monkeypatch.setattr(margin._Passes, "__init__", lambda self, blocks, *a: made.append(partitions(blocks)) or passes(self, blocks, *a))
    labelled = spark.range(20_000).select((F.col("id") % 2).cast("int").alias("label"), F.lit(1.0).alias("weight"),
                                          (F.col("id") % 2).cast("int").alias("fold"), F.array(F.lit(0.5) - F.col("id") % 2).alias("v"))
    from pyspark.ml.functions import array_to_vector
    margin.fit_margins(written(labelled.select("label", "weight", "fold", array_to_vector("v").alias("features")).coalesce(1), "one"), 1, 2, 0.5, 3)
    assert made[0] >= 5


def test_classes_do_not_meet_in_a_task(spark):
    """Cuts and sizes have a row per class: joined by a shuffle, two classes made two tasks of all rows."""
    df = written(spark.range(2_000).select(F.concat(F.lit("T"), "id").alias("ticket_id"), (F.col("id") % 5 == 0).cast("int").alias("mismatch")), "labels")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (features.stratified_split(df), features.oversample(df),
                     features.stratified_folds(df.withColumnRenamed("mismatch", "label"), 5)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        shares = {(r.mismatch, r.split): r["count"] for r in features.stratified_split(df).groupBy("mismatch", "split").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert shares == {(0, "train"): 1120, (0, "val"): 240, (0, "test"): 240, (1, "train"): 280, (1, "val"): 60, (1, "test"): 60}


@pytest.mark.parametrize("bigrams", [True, False])
@pytest.mark.parametrize("words", [1 << 21, 7])
def test_terms_are_counted_by_the_batch(spark, monkeypatch, bigrams, words):
    """One row per term of a batch is handed on, not one per occurrence."""
    monkeypatch.setattr(terms, "TALLY_WORDS", words)
    rows = ["red blue red blue", None, "", "x", "blue", "Red red red red red red red red red", "grün blue red"] * 30
    df = spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1)
    lists = [[w for w in (t or "").lower().split() if len(w) > 1] for t in rows]
    if bigrams:
        lists = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in lists]
    total, held = Counter(t for x in lists for t in x), Counter(t for x in lists for t in set(x))
    got = {r.term: (r.occurrences, r.texts) for r in terms.term_counts(df, "text", bigrams, 1).collect()}
    assert got == {t: (n, held[t]) for t, n in total.items()}
    handed = terms.tallies(df, "text", bigrams).count()
    assert handed == len(total) if words > 7 else handed >= len(total)
    assert terms.term_counts(df.limit(0), "text", bigrams, 1).count() == 0
