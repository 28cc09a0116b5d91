"""The two learned severity signals: text clusters and predicted resolution time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.severity import LABELS
from ..sources.tables import balanced, written
from .boosting import fit_regressor
from .clustering import MAX_ITERATIONS, RESTARTS, attach_cluster_severity, fit_clusters, rank_clusters
from .features import fit_label_encoder
from .filling import ALL_MISSING_MINUTES, median_filled
from .kmeans import fit_points
from .latent import FIT_ROWS, LatentModel, fit_latent
from .signals import quartile_bucket
from .terms import TfidfModel

CLUSTER_TERMS = 5000
COMPONENTS = 100
REGRESSION_TERMS = 100
# Bytes of latent vectors that are kept as tables; more are made anew by every pass over the sparse rows.
KEPT_BYTES = 6 << 30


def with_latent_vectors(
    df: DataFrame, text: str = "text", terms: int = CLUSTER_TERMS, k: int = COMPONENTS,
) -> tuple[DataFrame, LatentModel]:
    """Add `vector`, the L2-normalised latent coordinates of a text; other columns stay.

    The weights are a stage table with every column of `df`: the fit reads only
    its own columns from it, and nothing has to be joined back.
    """
    rows, latent = _weighted_rows(df, text, terms, k)
    vectors = rows.withColumn("vector", latent.vectors(F.col("indices"), F.col("weights")))
    return vectors.drop("indices", "weights"), latent


def _weighted_rows(df: DataFrame, text: str, terms: int, k: int) -> tuple[DataFrame, LatentModel]:
    """Stage table of df with term indices and weights, and the latent model of its rows."""
    model = TfidfModel.fit(df, text, terms)
    weighted = model.weights(df, text, "_w").withColumns({
        "indices": F.col("_w")["indices"], "weights": F.col("_w")["weights"]}).drop("_w")
    rows = written(weighted, "tfidf")
    return rows, fit_latent(rows, len(model.terms), k)


def with_text_clusters(
    df: DataFrame, text: str = "text", terms: int = CLUSTER_TERMS, k: int = COMPONENTS,
    seeds: Sequence[int] = range(42, 42 + RESTARTS), max_iter: int = MAX_ITERATIONS,
) -> DataFrame:
    """Add cluster_id, the best of several k-means runs over the latent vectors.

    Vectors take many times the room of the sparse rows they come from: beyond
    KEPT_BYTES the only table is that of the rows.
    """
    rows, latent = _weighted_rows(df, text, terms, k)
    vectors = rows.withColumn("vector", latent.vectors(F.col("indices"), F.col("weights"))).drop("indices", "weights")
    dims = latent.components.shape[1]
    if rows.count() * dims * 8 > KEPT_BYTES:
        sparse = balanced(rows.select("indices", "weights"), FIT_ROWS).persist(StorageLevel.MEMORY_ONLY)
        found = fit_points(sparse, latent.reader(df.sparkSession), dims, len(LABELS), list(seeds), max_iter)
        sparse.unpersist()
        return vectors.withColumn("cluster_id", found.nearest(F.col("vector"))).drop("vector")
    vectors = written(vectors, "vectors")
    found = fit_clusters(vectors, "vector", seeds=seeds, max_iter=max_iter)
    return vectors.withColumn("cluster_id", found.nearest(F.col("vector"))).drop("vector")


def cluster_signal(df: DataFrame, minutes: str | None = "resolution_minutes", **options) -> DataFrame:
    """Signal 2: add cluster_id and cluster_severity to cleaned tickets.

    Clusters rank by mean resolution time, or by size when there is no time.
    """
    texts = df.withColumn("_text", F.concat("subject", F.lit(" "), F.coalesce("description", F.lit(""))))
    clustered = written(with_text_clusters(texts, "_text", **options).drop("_text"), "clusters")
    if minutes is None:
        return attach_cluster_severity(clustered, rank_clusters(clustered, "size"))
    filled = median_filled(clustered, minutes, "_minutes")
    return attach_cluster_severity(filled, rank_clusters(filled, "time", "_minutes")).drop("_minutes")


def regression_signal(
    df: DataFrame, minutes: str | None = "resolution_minutes", trees: int = 100, depth: int = 4,
    step: float = 0.1, terms: int = REGRESSION_TERMS, seed: int = 42,
) -> DataFrame:
    """Signal 3: add predicted_minutes and regression_severity to cleaned tickets.

    Minutes are regressed on description terms, channel and category, predicted
    for the same rows and cut at their quartiles. Without a time column every
    ticket is Medium.
    """
    if minutes is None:
        return df.withColumns({
            "predicted_minutes": F.lit(None).cast("double"), "regression_severity": F.lit("Medium")})
    tfidf = TfidfModel.fit(df, "description", terms, sublinear=False, min_df=1)
    rows = tfidf.vectors(median_filled(df, minutes, "_label", ALL_MISSING_MINUTES), "description", "_terms")
    for column in ("channel", "category"):
        known = rows.withColumn(f"_{column}", F.coalesce(column, F.lit("Unknown")))
        rows = fit_label_encoder(known.select(f"_{column}"), f"_{column}", f"_{column}_code").transform(known)
        # Codes are plain numbers to the trees, however many there are.
        rows = rows.withColumn(f"_{column}_code", F.col(f"_{column}_code").alias(f"_{column}_code", metadata={}))
    rows = VectorSizeHint(inputCol="_terms", size=len(tfidf.terms), handleInvalid="optimistic").transform(rows)
    assembler = VectorAssembler(inputCols=["_terms", "_channel_code", "_category_code"], outputCol="_features")
    table = written(assembler.transform(rows).select(*df.columns, "_label", "_features"), "regression")
    known = balanced(table.select("_label", "_features")).persist()
    model = fit_regressor(known, len(tfidf.terms) + 2, GBTRegressor(
        maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, featuresCol="_features",
        labelCol="_label", predictionCol="predicted_minutes"))
    known.unpersist()
    predicted = written(model.transform(table).drop("_label", "_features"), "predicted")
    return quartile_bucket(predicted)
