"""Mismatch classifier: features, three models, soft vote, threshold and metrics."""

from __future__ import annotations

from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
)
from pyspark.ml.feature import StringIndexerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.rounding import round_exact
from ..sources.tables import balanced, written
from . import boosting
from .evaluation import class_weights, classification_metrics, quality_gates, threshold_sweep
from .features import TEXT_FEATURES, fit_label_encoder, moments, oversample, stratified_folds, stratified_split, text_features
from .filling import DEFAULT_MINUTES
from .margin import MarginModel, fit_margins, fit_sigmoids
from .terms import TfidfModel

CALIBRATION_FOLDS = 5
# Fits that run side by side, as in a parallel cross-validation.
PARALLEL_FITS = 4


@dataclass(frozen=True)
class Settings:
    """Hyperparameters; the defaults are the published ones.

    `include_delta` adds the severity delta as a feature, from which the label
    itself is computed: off unless asked for.
    """

    subject_terms: int = 2000
    description_terms: int = 3000
    include_delta: bool = False
    sampling: str = "weights"       # or "oversample"
    logistic_c: float = 1.0
    svm_c: float = 0.5
    logistic_iterations: int = 1000
    svm_iterations: int = 2000
    trees: int = 200
    depth: int = 5
    step: float = 0.1
    subsample: float = 0.8
    seed: int = 42


def with_numbers(df: DataFrame, include_delta: bool) -> DataFrame:
    """Numeric features of tickets that carry phrase hits and a resolution time."""
    out = text_features(df).withColumn("minutes", F.coalesce("resolution_minutes", F.lit(DEFAULT_MINUTES)))
    return out.withColumn("delta", F.coalesce("severity_delta", F.lit(0))) if include_delta else out


@dataclass(frozen=True)
class FeatureModel:
    subject: TfidfModel
    description: TfidfModel
    channels: list[str]
    means: dict[str, float]
    deviations: dict[str, float]

    @property
    def include_delta(self) -> bool:
        return "delta" in self.means

    @property
    def size(self) -> int:
        """Length of a feature vector."""
        return len(self.subject.terms) + len(self.description.terms) + len(self.means)

    @classmethod
    def fit(cls, df: DataFrame, settings: Settings) -> "FeatureModel":
        subject = TfidfModel.fit(df, "subject", settings.subject_terms)
        description = TfidfModel.fit(df, "description", settings.description_terms)
        encoder = fit_label_encoder(df, "channel", "channel_code")
        columns = [*TEXT_FEATURES, "channel_code", "minutes"] + (["delta"] if settings.include_delta else [])
        numbers = encoder.transform(with_numbers(df, settings.include_delta))
        row = moments(numbers, columns).first()
        return cls(subject, description, list(encoder.labels),
                   {c: row[f"mean_{c}"] for c in columns}, {c: row[f"std_{c}"] or 1.0 for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `features`: both text vectors and the standardised numbers, sparse."""
        encoder = StringIndexerModel.from_labels(
            self.channels, inputCol="channel", outputCol="channel_code", handleInvalid="keep")
        out = encoder.transform(with_numbers(df, self.include_delta))
        out = self.subject.vectors(out, "subject", "_subject")
        out = self.description.vectors(out, "description", "_description")
        # Named sizes keep the assembler from looking at the data.
        for column, model in (("_subject", self.subject), ("_description", self.description)):
            out = VectorSizeHint(inputCol=column, size=len(model.terms), handleInvalid="optimistic").transform(out)
        scaled = {f"_{c}": (F.col(c) - mean) / self.deviations[c] for c, mean in self.means.items()}
        assembler = VectorAssembler(inputCols=["_subject", "_description", *scaled], outputCol="features")
        made = [c for c in (*TEXT_FEATURES, "channel_code", "minutes", "delta") if c not in df.columns]
        return assembler.transform(out.withColumns(scaled)).drop("_subject", "_description", *scaled, *made)


@dataclass(frozen=True)
class MismatchModel:
    """Everything needed to score tickets."""

    features: FeatureModel
    logistic: LogisticRegressionModel
    svm: MarginModel
    trees: GBTClassificationModel
    threshold: float = 0.5

    def score(self, df: DataFrame) -> DataFrame:
        """Add the probability of each model and their mean, prob_mismatch."""
        return self.score_features(self.features.transform(df)).drop("features")

    def score_features(self, df: DataFrame) -> DataFrame:
        logistic = self.logistic.copy().setProbabilityCol("_p1").setRawPredictionCol("").setPredictionCol("")
        trees = self.trees.copy().setProbabilityCol("_p3").setRawPredictionCol("").setPredictionCol("")
        out = trees.transform(logistic.transform(df)).withColumns({
            "prob_logistic": vector_to_array("_p1")[1],
            "prob_svm": self.svm.probability(F.col("features")),
            "prob_trees": vector_to_array("_p3")[1],
        }).drop("_p1", "_p3")
        return out.withColumn("prob_mismatch", (F.col("prob_logistic") + F.col("prob_svm") + F.col("prob_trees")) / 3)


def fit_models(train: DataFrame, features: FeatureModel, settings: Settings) -> MismatchModel:
    """Fit the three models on rows with ticket_id, label, weight and features.

    The margin classifier is fitted once per stratified fold on the other folds and
    calibrated on its own; its probability is the mean of all of these.
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    rows = train.count()

    def fit_logistic() -> LogisticRegressionModel:
        return LogisticRegression(regParam=1 / (settings.logistic_c * rows), maxIter=settings.logistic_iterations,
                                  standardization=False, **common).fit(train)

    def fit_svm() -> MarginModel:
        folded = written(stratified_folds(train, CALIBRATION_FOLDS), "folds")
        weights = fit_margins(folded, features.size, CALIBRATION_FOLDS, settings.svm_c, settings.svm_iterations)
        margins = MarginModel(weights, (), ()).margins(F.col("features"))
        own = written(folded.select("fold", "label", "weight", F.element_at(margins, F.col("fold") + 1).alias("margin")), "margins")
        return MarginModel(weights, *fit_sigmoids(own, CALIBRATION_FOLDS))

    def fit_trees() -> GBTClassificationModel:
        return boosting.fit_classifier(train, features.size, GBTClassifier(
            maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.step,
            subsamplingRate=settings.subsample, seed=settings.seed, **common))

    # The trees take longest.
    target = inheritable_thread_target(train.sparkSession)
    with ThreadPool(PARALLEL_FITS) as pool:
        trees, logistic, svm = [r.get() for r in [pool.apply_async(target(f)) for f in (fit_trees, fit_logistic, fit_svm)]]
    return MismatchModel(features, logistic, svm, trees)


@dataclass(frozen=True)
class Training:
    model: MismatchModel
    test_predictions: DataFrame    # per test ticket: id, prediction, probability, label
    test_tickets: DataFrame        # the input rows of the test split
    metrics: DataFrame             # one row
    validation: DataFrame          # accuracy per model
    sweep: DataFrame               # threshold sweep on the validation split


def train_classifier(df: DataFrame, settings: Settings = Settings(), key: str = "ticket_id") -> Training:
    """Split, fit, choose the threshold on validation rows and measure on test rows.

    `df` holds cleaned tickets with phrase hits and the label `mismatch`, a stage
    table for preference. Labels other than 0 and 1, and tables without both, raise.
    """
    placed = written(stratified_split(df, "mismatch", key), "split")
    split = balanced(placed).persist()
    kinds = {r["mismatch"] for r in split.select("mismatch").distinct().limit(3).collect()}
    if kinds != {0, 1}:
        raise ValueError(f"the label must be 0 and 1, found {sorted(kinds, key=str)}")
    train_rows = split.where("split = 'train'")
    features = FeatureModel.fit(train_rows, settings)
    table = features.transform(split.withColumn("label", F.col("mismatch"))).select(
        F.col(key).alias("ticket_id"), "label", "split", "features")
    table = written(table, "features")
    split.unpersist()
    train = table.where("split = 'train'")
    if settings.sampling == "oversample":
        train = oversample(train, "label", "ticket_id", settings.seed).withColumn("weight", F.lit(1.0))
    else:
        weights = class_weights(train, "label").select("label", "weight")
        train = train.join(F.broadcast(weights), "label")
    train = balanced(written(train, "train")).persist()
    model = fit_models(train, features, settings)
    train.unpersist()

    held_out = written(model.score_features(balanced(table.where("split <> 'train'"))).drop("features"), "held-out")
    validation = held_out.where("split = 'val'")
    sweep = threshold_sweep(validation, "label", "prob_mismatch")
    best = sweep.where("is_best").first()["threshold"]
    model = replace(model, threshold=best)

    test = held_out.where("split = 'test'").select(
        "ticket_id", (F.col("prob_mismatch") >= best).cast("int").alias("predicted_label"),
        round_exact(F.col("prob_mismatch"), 4).alias("prob_mismatch"), F.col("label").alias("true_label"))
    return Training(model, test, placed.where("split = 'test'"), test_metrics(test, best),
                    validation_accuracy(validation), sweep)


def validation_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy at 0.5 of each model and of their mean."""
    names = {"logistic": "prob_logistic", "svm": "prob_svm", "trees": "prob_trees", "ensemble": "prob_mismatch"}
    row = scored.agg(*[F.avg(((F.col(c) >= 0.5).cast("int") == F.col("label")).cast("int")).alias(n)
                       for n, c in names.items()])
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return row.selectExpr(f"stack({len(names)}, {pairs}) AS (model, accuracy)")


def test_metrics(test: DataFrame, threshold: float) -> DataFrame:
    """One row: test measures, threshold, whether all gates pass, confusion matrix."""
    cells = test.agg(F.array(*[F.array(*[
        F.count_if((F.col("true_label") == i) & (F.col("predicted_label") == j)) for j in (0, 1)]) for i in (0, 1)]
    ).alias("confusion_matrix"))
    gates = quality_gates(classification_metrics(test))
    return gates.select(
        round_exact(F.col("accuracy"), 4).alias("test_accuracy"), round_exact(F.col("macro_f1"), 4).alias("test_f1_macro"),
        round_exact(F.col("recall_0"), 4).alias("test_recall_class0"), round_exact(F.col("recall_1"), 4).alias("test_recall_class1"),
        F.lit(round(threshold, 2)).alias("best_threshold"), F.col("all_passed").alias("all_thresholds_passed"),
        cells.scalar().alias("confusion_matrix"))


test_metrics.__test__ = False
