"""Measures over signals, predictions and robustness tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicons as lx
from ..functions.matching import distinct_hits
from ..functions.rounding import round_exact
from ..functions.rules import combine, rule_override
from ..functions.severity import density_weighted, severity_number

# Acceptance gates, thresholds tried, baseline rule, robustness gate.
GATES = {"accuracy": 0.83, "macro_f1": 0.82, "recall_0": 0.78, "recall_1": 0.78}
THRESHOLDS = tuple(round(0.30 + 0.02 * i, 2) for i in range(20))
KEYWORD_BASELINE_HITS = 3
ROBUSTNESS_SHARE = 0.7

SIGNAL_COLUMNS = ("llm_severity_score", "cluster_severity", "regression_severity", "rule_nlp_severity")


def agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """Percent of rows where two severity columns name the same level."""
    same = severity_number(F.col(first)) == severity_number(F.col(second))
    return df.agg(round_exact(F.avg(same.cast("int")) * 100, 1).alias("agreement"))


def ablation(df: DataFrame, signals: Sequence[str] = SIGNAL_COLUMNS) -> DataFrame:
    """Per signal: percent of tickets where its own mismatch flag equals the fused one."""
    def same(name: str) -> Column:
        own = F.abs(severity_number(F.col(name)) - F.col("assigned_num")) >= 2
        return F.avg((own.cast("int") == F.col("mismatch")).cast("int")) * 100

    row = df.agg(*[same(name).alias(f"m{i}") for i, name in enumerate(signals)])
    pairs = ", ".join(f"'{name}', m{i}" for i, name in enumerate(signals))
    return row.selectExpr(f"stack({len(signals)}, {pairs}) AS (signal, share)").select(
        "signal", round_exact(F.col("share"), 1).alias("agreement_with_fused"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """All four cells of the 2x2 table, empty ones included."""
    cells = [(i, j) for i in (0, 1) for j in (0, 1)]
    row = df.agg(*[F.count_if((F.col(label) == i) & (F.col(prediction) == j)).alias(f"m{i}{j}") for i, j in cells])
    pairs = ", ".join(f"{i}, {j}, m{i}{j}" for i, j in cells)
    return row.selectExpr(f"stack(4, {pairs}) AS (true_label, predicted_label, n)")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def _scores(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """All measures of a 2x2 table; a ratio without rows is 0."""
    out = {
        "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
        "precision_0": _ratio(tn, tn + fn), "recall_0": _ratio(tn, tn + fp),
        "precision_1": _ratio(tp, tp + fp), "recall_1": _ratio(tp, tp + fn),
        "f1_0": _ratio(2 * tn, 2 * tn + fp + fn), "f1_1": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    out["macro_f1"] = (out["f1_0"] + out["f1_1"]) / 2
    out["support_0"], out["support_1"] = tn + fp, fn + tp
    return out


def classification_metrics(df: DataFrame, label: str = "true_label", prediction: str = "predicted_label") -> DataFrame:
    """One row: accuracy, macro F1, and precision, recall, F1 and support per class."""
    def cell(i: int, j: int) -> Column:
        return F.count_if((F.col(label) == i) & (F.col(prediction) == j))

    row = df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    scores = _scores(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return row.select(*[value.alias(name) for name, value in scores.items()])


def quality_gates(metrics: DataFrame) -> DataFrame:
    """Each gated measure with whether it passes, and whether all do."""
    passed = {name: F.col(name) >= gate for name, gate in GATES.items()}
    everything = F.lit(True)
    for ok in passed.values():
        everything = everything & ok
    return metrics.select(
        *GATES, *[ok.alias(f"{name}_passed") for name, ok in passed.items()], everything.alias("all_passed"))


def threshold_sweep(df: DataFrame, label: str, probability: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Macro F1 at each threshold; the first best one is marked.

    Rows are counted once by how many thresholds they reach; the sweep itself
    runs over that table of at most 21 rows.
    """
    ordered = sorted(thresholds)
    reached = F.lit(0)
    for t in ordered:
        reached = reached + (F.col(probability) >= F.lit(t)).cast("int")
    counts = df.groupBy(reached.alias("_reached")).agg(
        F.count_if(F.col(label) == 0).alias("_n0"), F.count_if(F.col(label) == 1).alias("_n1"))
    # For threshold i (1-based) a row is predicted 1 when it reaches at least i of them.
    per_threshold = counts.agg(*[
        F.coalesce(F.sum(F.when(F.col("_reached") >= i, F.col(n)) if hit else F.when(F.col("_reached") < i, F.col(n))),
                   F.lit(0)).alias(f"{name}{i}")
        for i in range(1, len(ordered) + 1)
        for name, n, hit in (("tn", "_n0", False), ("fp", "_n0", True), ("fn", "_n1", False), ("tp", "_n1", True))
    ])
    pairs = ", ".join(f"{t}D, tn{i}, fp{i}, fn{i}, tp{i}" for i, t in enumerate(ordered, start=1))
    table = per_threshold.selectExpr(f"stack({len(ordered)}, {pairs}) AS (threshold, tn, fp, fn, tp)")
    scores = _scores(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    swept = table.select("threshold", scores["accuracy"].alias("accuracy"), scores["macro_f1"].alias("macro_f1"))
    best = Window.orderBy(F.desc("macro_f1"), "threshold")
    return swept.withColumn("is_best", F.row_number().over(best) == 1)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (2 n_c) of each of the two classes."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == c).alias(f"n{c}") for c in (0, 1)])
    return row.selectExpr("stack(2, 0, n0, try_divide(n, 2 * n0), 1, n1, try_divide(n, 2 * n1)) AS (label, n, weight)")


def content_counts(df: DataFrame, trivial: Sequence[str] = lx.TRIVIAL_CONTENT_32) -> DataFrame:
    """Distinct critical and trivial content phrases, from the phrase hits."""
    return df.withColumns({
        "critical_hits": distinct_hits(F.col("hits"), lx.CRITICAL_CONTENT),
        "trivial_hits": distinct_hits(F.col("hits"), trivial),
    })


def with_rule_override(
    df: DataFrame, minutes: str = "resolution_minutes", priority: str = "assigned_num", interactive: bool = False,
) -> DataFrame:
    """Add rule_name and rule_prob (null when no rule fires) and the counts behind them.

    The interactive variant knows more trivial phrases and negations and rounds
    the density.
    """
    counted = content_counts(df, lx.TRIVIAL_CONTENT_45 if interactive else lx.TRIVIAL_CONTENT_32)
    density = density_weighted(
        F.col("hits"), F.col("words"), lx.ESCALATION_15, lx.NEGATIONS_11 if interactive else lx.NEGATIONS_9)
    outcome = rule_override(
        F.col(priority), F.col("critical_hits"), F.col("trivial_hits"), F.col(minutes),
        round_exact(density, 4) if interactive else density)
    return counted.withColumns({"rule_name": outcome.name, "rule_prob": outcome.probability})


def with_hybrid(df: DataFrame, mode: str, threshold: Column, model: str = "prob_mismatch") -> DataFrame:
    """Add final_pred, final_prob and source from model and rule probabilities."""
    outcome = combine(mode, F.col(model), F.col("rule_prob"), threshold)
    return df.withColumns({
        "final_pred": outcome.predicted, "final_prob": outcome.probability, "source": outcome.source})


def keyword_baseline(df: DataFrame) -> DataFrame:
    """Prediction of a system that only counts escalation phrases."""
    hits = distinct_hits(F.col("hits"), [p for p, _ in lx.ESCALATION_15])
    return df.withColumn("escalation_phrases", hits).withColumn(
        "keyword_pred", (F.col("escalation_phrases") >= KEYWORD_BASELINE_HITS).cast("int"))


def robustness_score(df: DataFrame, expected: str = "expected_mismatch", predicted: str = "final_pred",
                     baseline: str = "keyword_pred") -> DataFrame:
    """One row: correct predictions, baseline score, gain and whether 7 in 10 are right.

    Detections and false alarms are counted apart, so negative tickets matter.
    """
    right, base = F.col(predicted) == F.col(expected), F.col(baseline) == F.col(expected)
    row = df.agg(
        F.count("*").alias("total_tickets"),
        F.count_if(right).alias("correctly_detected"),
        F.count_if(base).alias("keyword_baseline_score"),
        F.count_if((F.col(expected) == 1) & (F.col(predicted) == 1)).alias("true_detections"),
        F.count_if((F.col(expected) == 0) & (F.col(predicted) == 1)).alias("wrong_detections"),
    )
    return row.withColumn("improvement", F.col("correctly_detected") - F.col("keyword_baseline_score")).withColumn(
        "bonus_achieved", F.col("correctly_detected") * 10 >= F.col("total_tickets") * int(ROBUSTNESS_SHARE * 10))
