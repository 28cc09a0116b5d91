"""Severity signals of a ticket that need no learning, and the phrase hits they share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicons as lx
from ..functions.matching import phrase_hits, top_phrase
from ..functions.rounding import round_exact
from ..functions.severity import (
    density_double_hits, density_label, density_weighted, quartile_severity, resolution_tier, severity_number,
    tiered_severity,
)
from ..functions.text import joined_text, word_count
from .statistics import QUARTILES, with_quantiles

FIXED_CUTS = {"p25": 30.0, "p50": 60.0, "p75": 120.0}


def with_phrase_hits(df: DataFrame) -> DataFrame:
    """Add hits (array of phrase occurrences), words and description_words.

    The only step that reads the texts; the other signals read these columns.
    """
    text = joined_text(F.col("subject"), F.col("description"))
    return df.withColumns({
        "hits": phrase_hits(text),
        "description_words": word_count(F.col("description")),
    }).withColumn("words", word_count(F.col("subject")) + F.col("description_words"))


def tier_signal(df: DataFrame, short_tiers: bool = False) -> DataFrame:
    """Signal 1: llm_severity_score and its number, by tiered phrases."""
    label = tiered_severity(F.col("hits"), F.col("description_words"), short_tiers)
    return df.withColumn("llm_severity_score", label).withColumn(
        "llm_severity_num", severity_number(F.col("llm_severity_score")))


def density_signal(
    df: DataFrame,
    escalation: Sequence[tuple[str, float]] = lx.ESCALATION_16,
    negations: Sequence[str] = lx.NEGATIONS_11,
    rounded: bool = True,
) -> DataFrame:
    """Signal 4: raw_density, keyword_density (4 digits) and rule_nlp_severity.

    Buckets use the rounded density unless told otherwise.
    """
    raw = density_weighted(F.col("hits"), F.col("words"), escalation, negations)
    out = df.withColumn("raw_density", raw).withColumn("keyword_density", round_exact(F.col("raw_density"), 4))
    return out.withColumn("rule_nlp_severity", density_label(F.col("keyword_density" if rounded else "raw_density")))


def double_hit_density(df: DataFrame) -> DataFrame:
    """The density variant that counts every escalation occurrence twice."""
    density, escalation, negation = density_double_hits(F.col("hits"), F.col("words"))
    return df.withColumns({
        "raw_density": density, "escalation_hits": escalation, "negation_hits": negation,
    }).withColumn("keyword_density", round_exact(F.col("raw_density"), 4)).withColumn(
        "rule_nlp_severity", density_label(F.col("keyword_density")))


def top_keyword(df: DataFrame, escalation: Sequence[tuple[str, float]] = lx.ESCALATION_15) -> DataFrame:
    phrase, weight = top_phrase(F.col("hits"), escalation)
    return df.withColumns({"top_keyword": phrase, "keyword_weight": weight})


def quartile_bucket(df: DataFrame, value: str = "predicted_minutes", out: str = "regression_severity") -> DataFrame:
    """Severity by the quartiles of a predicted resolution time."""
    bounded = with_quantiles(df, value, QUARTILES)
    return bounded.withColumn(
        out, quartile_severity(F.col(value), F.col("p25"), F.col("p50"), F.col("p75"))).drop(*QUARTILES)


def tier_by_quartiles(df: DataFrame, value: str = "resolution_minutes") -> DataFrame:
    """Resolution tier by the quartiles of the table itself; keeps the cuts."""
    bounded = with_quantiles(df, value, QUARTILES)
    return bounded.withColumn(
        "resolution_tier", resolution_tier(F.col(value), F.col("p25"), F.col("p50"), F.col("p75")))


def tier_by_fixed_cuts(df: DataFrame, value: str = "resolution_minutes") -> DataFrame:
    """Resolution tier by fixed cuts of 30, 60 and 120 minutes; stateless."""
    cuts = {name: F.lit(minutes) for name, minutes in FIXED_CUTS.items()}
    return df.withColumns({**cuts, "resolution_tier": resolution_tier(F.col(value), *cuts.values())})
