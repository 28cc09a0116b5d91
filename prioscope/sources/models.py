"""Saving and loading a trained mismatch model as a folder of Spark data."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import SparkSession

from ..operators.classifier import FeatureModel, MismatchModel
from ..operators.margin import MarginModel
from ..operators.terms import TfidfModel

PARTS = {"logistic": LogisticRegressionModel, "trees": GBTClassificationModel}
TEXTS = ("subject", "description")


def save_model(spark: SparkSession, model: MismatchModel, path: str) -> None:
    for name in PARTS:
        getattr(model, name).write().overwrite().save(f"{path}/{name}")
    folds = [(fold, weights, slope, offset) for fold, (weights, slope, offset) in enumerate(
        zip(model.svm.weights.tolist(), model.svm.slopes, model.svm.offsets))]
    spark.createDataFrame(folds, "fold int, weights array<double>, slope double, offset double").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/svm")
    terms = [(text, i, term, idf) for text in TEXTS
             for i, (term, idf) in enumerate(zip(getattr(model.features, text).terms, getattr(model.features, text).idf))]
    spark.createDataFrame(terms, "text string, position int, term string, idf double").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/terms")
    numbers = [(i, name, mean, model.features.deviations[name]) for i, (name, mean) in enumerate(model.features.means.items())]
    spark.createDataFrame(numbers, "position int, name string, mean double, deviation double").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/numbers")
    spark.createDataFrame(
        [(model.features.channels, float(model.threshold))], "channels array<string>, threshold double",
    ).write.mode("overwrite").parquet(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> MismatchModel:
    """Reads the folder; a missing or damaged part raises."""
    parts = {name: kind.load(f"{path}/{name}") for name, kind in PARTS.items()}
    terms = spark.read.parquet(f"{path}/terms").orderBy("text", "position").collect()
    texts = {t: TfidfModel([r.term for r in terms if r.text == t], [r.idf for r in terms if r.text == t]) for t in TEXTS}
    numbers = spark.read.parquet(f"{path}/numbers").orderBy("position").collect()
    row = spark.read.parquet(f"{path}/settings").first()
    features = FeatureModel(
        texts["subject"], texts["description"], list(row.channels),
        {r.name: r.mean for r in numbers}, {r.name: r.deviation for r in numbers})
    folds = spark.read.parquet(f"{path}/svm").orderBy("fold").collect()
    svm = MarginModel(np.array([r.weights for r in folds]), tuple(r.slope for r in folds), tuple(r.offset for r in folds))
    return MismatchModel(features, svm=svm, threshold=row.threshold, **parts)
