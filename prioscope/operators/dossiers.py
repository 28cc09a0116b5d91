"""Evidence dossiers: one structured record per flagged ticket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.evidence import STYLES, Evidence, evidence
from ..functions.severity import clean_priority
from .filling import DEFAULT_MINUTES
from .signals import FIXED_CUTS
from .statistics import QUARTILES, with_quantiles


def attach_tickets(predictions: DataFrame, tickets: DataFrame, columns: list[str], key: str = "ticket_id") -> DataFrame:
    """Left join of predictions to ticket columns by id; clashing names get `_full`.

    Repeated ids on the ticket side contribute their smallest row, so no
    prediction is multiplied.
    """
    one_each = tickets.groupBy(key).agg(F.min(F.struct(*columns)).alias("_t"))
    renamed = one_each.select(key, *[
        F.col("_t")[c].alias(f"{c}_full" if c in predictions.columns else c) for c in columns])
    return predictions.join(renamed, key, "left")


def _evidence(df: DataFrame, style: str, cuts: tuple[Column, Column, Column]) -> Evidence:
    return evidence(
        STYLES[style],
        subject=F.col("subject"), description=F.col("description"), assigned=F.col("assigned_priority"),
        inferred=F.col("inferred_severity"), predicted=F.col("predicted_label"), probability=F.col("prob_mismatch"),
        minutes=F.col("_minutes"), hits=F.col("hits"), words=F.col("words"), cuts=cuts,
    )


def with_cuts(df: DataFrame, style: str, minutes: str = "resolution_minutes") -> DataFrame:
    """Tier cuts p25, p50, p75: the table's own quartiles for full records, else fixed ones."""
    if style == "full":
        return with_quantiles(df, minutes, QUARTILES)
    return df.withColumns({name: F.lit(value) for name, value in FIXED_CUTS.items()})


def _flagged(df: DataFrame, style: str, minutes: str) -> DataFrame:
    cut = with_cuts(df, style, minutes).where(F.col("predicted_label") == 1)
    return cut.withColumns({
        "_minutes": F.coalesce(F.col(minutes), F.lit(DEFAULT_MINUTES)),
        "assigned_priority": clean_priority(F.col("assigned_priority")),
        "inferred_severity": clean_priority(F.col("inferred_severity")),
    })


def dossiers(df: DataFrame, style: str = "full", minutes: str = "resolution_minutes") -> DataFrame:
    """Nested records of the flagged tickets.

    Needs ticket_id, subject, description, assigned_priority, inferred_severity,
    predicted_label, prob_mismatch, resolution minutes, hits and words.
    """
    rows = _flagged(df, style, minutes)
    e = _evidence(rows, style, (F.col("p25"), F.col("p50"), F.col("p75")))
    return rows.select(
        "ticket_id", "assigned_priority", "inferred_severity", e.mismatch_type.alias("mismatch_type"),
        e.severity_delta.alias("severity_delta"), e.signals.alias("feature_evidence"),
        e.constraint_analysis.alias("constraint_analysis"), e.confidence.alias("confidence"),
    )


def flat_dossiers(df: DataFrame, style: str = "full", minutes: str = "resolution_minutes") -> DataFrame:
    """The same records with one plain column per statement."""
    rows = _flagged(df, style, minutes)
    e = _evidence(rows, style, (F.col("p25"), F.col("p50"), F.col("p75")))
    return rows.select(
        "ticket_id", "assigned_priority", "inferred_severity", e.mismatch_type.alias("mismatch_type"),
        e.severity_delta.alias("severity_delta"), e.top_keyword.alias("top_keyword"),
        e.keyword_weight.alias("keyword_weight"), e.keyword_density.alias("keyword_density"),
        e.resolution_tier.alias("resolution_tier"), e.resolution_note.alias("resolution_note"),
        e.constraint_analysis.alias("constraint_analysis"), e.confidence.alias("confidence"),
    )


def dossier_summary(df: DataFrame, threshold: Column | None = None) -> DataFrame:
    """One row of counts over scored tickets with predicted_label and mismatch_type."""
    flagged = F.col("predicted_label") == 1
    row = df.agg(
        F.count("*").alias("total_tickets"),
        F.count_if(flagged).alias("mismatch_count"),
        F.count_if(flagged & (F.col("mismatch_type") == "Hidden Crisis")).alias("hidden_crisis_count"),
        F.count_if(flagged & (F.col("mismatch_type") == "False Alarm")).alias("false_alarm_count"),
    )
    return row if threshold is None else row.withColumn("threshold_used", threshold)


def dossier_examples(records: DataFrame, key: str = "ticket_id") -> DataFrame:
    """First record, by key, of each mismatch type; combined before the shuffle."""
    fields = [key, "assigned_priority", "inferred_severity", "severity_delta", "confidence"]
    first = records.groupBy("mismatch_type").agg(F.min_by(F.struct(*fields), F.col(key)).alias("_first"))
    return first.select("mismatch_type", "_first.*")
