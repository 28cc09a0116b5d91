"""The severity scale and everything that maps onto it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import lexicons as lx
from .matching import any_hit, distinct_hits, total_hits, weighted_hits
from .text import strip

# The scale, lowest first.
LABELS = ("Low", "Medium", "High", "Critical")
NUMBERS = {label: number for number, label in enumerate(LABELS, start=1)}

# Density and probability cuts.
DENSITY_CUTS = ((0.08, "Critical"), (0.05, "High"), (0.02, "Medium"))
PROBABILITY_CUTS = ((0.80, "Critical"), (0.65, "High"))


def severity_number(col: Column) -> Column:
    """1 to 4 for a label in any case or padding; anything else counts as Medium."""
    key = F.lower(strip(col.cast("string")))
    value = F.when(key == "low", 1).when(key == "high", 3).when(key == "critical", 4)
    return value.otherwise(2)


def severity_label(number: Column) -> Column:
    return (
        F.when(number == 1, "Low").when(number == 3, "High").when(number == 4, "Critical").otherwise("Medium")
    )


def clean_priority(col: Column) -> Column:
    return severity_label(severity_number(col))


def tiered_severity(hits: Column, description_words: Column, short_tiers: bool = False) -> Column:
    """Signal 1: the highest phrase tier present, raised by negation, else text length."""
    keep = [p for p in lx.TIER_MEDIUM if not (short_tiers and p in lx.TIER_SHORT_OMITS)]
    low_keep = [p for p in lx.TIER_LOW if not (short_tiers and p in lx.TIER_SHORT_OMITS)]
    high = distinct_hits(hits, lx.TIER_HIGH)
    negated = any_hit(hits, lx.TIER_NEGATIONS)
    return (
        F.when(any_hit(hits, lx.TIER_CRITICAL), "Critical")
        .when((high >= 2) & negated, "Critical")
        .when(high >= 1, "High")
        .when(any_hit(hits, keep), F.when(negated, "High").otherwise("Medium"))
        .when(any_hit(hits, low_keep), "Low")
        .when(description_words > 80, "High")
        .when(description_words > 15, "Medium")
        .otherwise("Low")
    )


def density_weighted(
    hits: Column,
    words: Column,
    escalation: Sequence[tuple[str, float]] = lx.ESCALATION_16,
    negations: Sequence[str] = lx.NEGATIONS_11,
) -> Column:
    """Weighted escalation plus negation occurrences per word."""
    return (weighted_hits(hits, escalation) + total_hits(hits, negations)) / F.greatest(words, F.lit(1))


def density_double_hits(
    hits: Column,
    words: Column,
    escalation: Sequence[tuple[str, float]] = lx.ESCALATION_13,
    negations: Sequence[str] = lx.NEGATIONS_7,
) -> tuple[Column, Column, Column]:
    """Density counting each escalation occurrence twice, with both counts."""
    esc = total_hits(hits, [phrase for phrase, _ in escalation])
    neg = total_hits(hits, negations)
    return (esc * 2 + neg) / F.greatest(words, F.lit(1)), esc, neg


def density_label(density: Column) -> Column:
    value = None
    for cut, label in DENSITY_CUTS:
        value = F.when(density > cut, label) if value is None else value.when(density > cut, label)
    return value.otherwise("Low")


def fuse_ceil_mean(first: Column, second: Column) -> Column:
    """Fused severity number: the mean of two signals, rounded up."""
    return F.least(F.ceil((first + second) / 2), F.lit(4)).cast("int")


def fuse_majority(signals: Sequence[Column]) -> Column:
    """Most frequent severity number; the first signal decides ties."""
    votes = {n: sum((s == n).cast("int") for s in signals) for n in range(1, 5)}
    best = F.greatest(*votes.values())
    tied = sum((v == best).cast("int") for v in votes.values())
    winner = F.when(votes[1] == best, 1).when(votes[2] == best, 2).when(votes[3] == best, 3).otherwise(4)
    return F.when(tied > 1, signals[0]).otherwise(winner)


def quartile_severity(value: Column, p25: Column, p50: Column, p75: Column) -> Column:
    """Bucket by quartiles; equal values always share a bucket."""
    return F.when(value >= p75, "Critical").when(value >= p50, "High").when(value >= p25, "Medium").otherwise("Low")


def resolution_tier(minutes: Column, p25: Column, p50: Column, p75: Column) -> Column:
    """Tier of a resolution time, strictly above each cut; null is Unknown."""
    return (
        F.when(minutes.isNull(), "Unknown")
        .when(minutes > p75, "Critical").when(minutes > p50, "High").when(minutes > p25, "Medium").otherwise("Low")
    )


def severity_from_probability(predicted: Column, probability: Column, otherwise: Column, interactive: bool = False) -> Column:
    """Severity implied by a mismatch probability; `otherwise` when none is predicted."""
    value = F.when(predicted == 0, otherwise)
    for cut, label in PROBABILITY_CUTS:
        value = value.when(probability > cut, label)
    if interactive:
        return value.when(probability > 0.50, "Medium").otherwise("Low")
    return value.otherwise("Medium")


def mismatch_type(predicted: Column, delta: Column, probability: Column | None) -> Column:
    """Hidden Crisis or False Alarm by the sign of delta, None without a prediction.

    With a probability, delta 0 is decided at 0.5; without, it counts as Hidden Crisis.
    """
    level = F.when(delta > 0, "Hidden Crisis").when(delta < 0, "False Alarm")
    if probability is None:
        level = level.otherwise("Hidden Crisis")
    else:
        level = level.when(probability >= 0.5, "Hidden Crisis").otherwise("False Alarm")
    return F.when(predicted == 1, level).otherwise("None")
