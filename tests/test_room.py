"""Clusters of texts without a table of their vectors."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prioscope.operators import kmeans, latent, learned
from prioscope.sources.tables import work_folder, written


@pytest.fixture(scope="module")
def texts(spark):
    words = ["disk", "mail", "login", "page", "error", "slow", "bill", "font"]
    draw = np.random.default_rng(6)
    rows = [(f"T{i}", " ".join(words[(i % 4) * 2 + int(b)] for b in draw.integers(0, 2, 6))) for i in range(600)] + [("empty", ""), ("none", None)]
    return spark.createDataFrame(rows, "ticket_id string, text string").repartition(3)



def test_large_vectors_are_not_kept(spark, texts, monkeypatch):
    """Vectors and points were two tables, each many times the size of the sparse rows."""
    kept = {r.ticket_id: r.cluster_id for r in learned.with_text_clusters(texts, k=4, seeds=(1, 2, 3)).collect()}
    before = set(os.listdir(work_folder(spark).removeprefix("file:")))
    monkeypatch.setattr(learned, "KEPT_BYTES", 0)
    made = learned.with_text_clusters(texts, k=4, seeds=(1, 2, 3))
    assert made.columns == ["ticket_id", "text", "cluster_id"]
    anew = {r.ticket_id: r.cluster_id for r in made.collect()}
    new = {name.rsplit("-", 1)[0] for name in set(os.listdir(work_folder(spark).removeprefix("file:"))) - before}
    assert "tfidf" in new and not new & {"vectors", "points"}
    # The same groups, whatever their numbers.
    assert len({(kept[k], anew[k]) for k in kept}) == len(set(kept.values())) == len(set(anew.values()))


def test_points_made_in_every_pass(spark):
    draw = np.random.default_rng(7)
    rows = [([0, 1, 2], w) for w in draw.normal(size=(900, 3)).tolist()] + [([], [])]
    df = written(spark.createDataFrame(rows, "indices array<int>, weights array<double>").repartition(4), "sparse")
    model = latent.fit_latent(df, 3, 2)
    found = kmeans.fit_points(df, model.reader(spark), 2, 3, [1, 2], 100, 0.0)
    points = np.array([r.v for r in df.select(model.vectors(F.col("indices"), F.col("weights")).alias("v")).collect()])
    assert found.cost == pytest.approx(((points[:, None] - found.centres) ** 2).sum(axis=2).min(axis=1).sum(), rel=1e-9)
    assert found.cost == min(found.costs) and len(found.costs) == 2
    assert kmeans.fit_points(df.limit(0), model.reader(spark), 2, 3, [1], 100).cost == 0.0
