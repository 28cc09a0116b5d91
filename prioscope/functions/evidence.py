"""Evidence records: the texts and nested structure that explain a flagged ticket."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from . import lexicons as lx
from .matching import top_phrase
from .rounding import round_exact
from .severity import (
    density_double_hits, density_label, density_weighted, mismatch_type, resolution_tier, severity_number,
)
from .text import fixed, or_empty, percent, snippet

# --- Fixed values: message formats ------------------------------------------
FULL_TIERS = {
    "Critical": "{rt1} min — top quartile (P75={p75} min), complex case.",
    "High": "{rt1} min — above median ({p50} min), above-average effort.",
    "Medium": "{rt1} min — second quartile, moderate complexity.",
    "Low": "{rt1} min — bottom quartile (<=P25={p25} min), straightforward.",
    "Unknown": "Resolution time unavailable.",
}
BATCH_TIERS = {
    "Critical": "{rt1} min -- top quartile (P75={p75} min), indicative of a complex or escalated case.",
    "High": "{rt1} min -- above the median ({p50} min), above-average resolution effort.",
    "Medium": "{rt1} min -- second quartile (P25={p25}--P50={p50} min), moderate complexity.",
    "Low": "{rt1} min -- bottom quartile (≤P25={p25} min), straightforward resolution.",
    "Unknown": "Resolution time data unavailable.",
}
INTERACTIVE_TIERS = {
    "Critical": "{rt0} min — top quartile, complex case.",
    "High": "{rt0} min — above median effort.",
    "Medium": "{rt0} min — moderate complexity.",
    "Low": "{rt0} min — straightforward resolution.",
    "Unknown": "RT unavailable.",
}
FULL_CRISIS = (
    "Ticket '{subject}' describes a {inferred}-severity issue but was assigned {assigned} — {gap} severity "
    "level(s) lower. {keyword_note}Resolution time ({rt0} min, {tier} tier) corroborates higher severity. "
    'Excerpt: "{excerpt}"'
)
FULL_ALARM = (
    "Ticket '{subject}' was assigned {assigned} but signals infer {inferred} — {gap} level(s) lower. "
    "Keyword density ({density4}) and resolution time ({rt0} min, {tier} tier) are both consistent with "
    '{inferred} severity. Excerpt: "{excerpt}"'
)
BATCH_CRISIS = (
    "The ticket '{subject}' describes a {inferred}-severity issue yet was assigned {assigned} -- a gap of {gap} "
    "severity level(s). {keyword_note}Resolution time ({rt} min, {tier} tier) corroborates severity inference. "
    'Excerpt: "{excerpt}"'
)
BATCH_ALARM = (
    "The ticket '{subject}' was assigned {assigned} priority, but multi-signal analysis infers {inferred} -- {gap} "
    "level(s) lower. Keyword density ({density4}) {density_note}the described issue does not constitute "
    "{assigned}-tier impact. Resolution time ({rt} min, {tier} tier) is consistent with {inferred} severity. "
    'Excerpt: "{excerpt}"'
)
BATCH_CONSISTENT = (
    "Signals are consistent: '{subject}' aligns with {assigned} priority. Keyword density ({density4}) and "
    "resolution time ({rt} min, {tier} tier) both support the assigned severity level."
)
INTERACTIVE_CRISIS = (
    "'{subject}' describes a {inferred}-severity issue but was assigned {assigned} ({gap} level(s) lower). "
    '{keyword_note}RT ({rt0} min, {tier} tier) corroborates. Excerpt: "{excerpt}"'
)
INTERACTIVE_ALARM = (
    "'{subject}' was assigned {assigned} but signals infer {inferred} ({gap} level(s) lower). "
    "Keyword density ({density4}) and RT ({rt0} min) consistent with {inferred}."
)


@dataclass(frozen=True)
class Style:
    """One published wording of the record, with the lexicon variant it goes with."""

    tiers: dict[str, str]
    crisis: str
    alarm: str
    keyword_found: str
    keyword_missing: str
    nothing: str
    subject_chars: int
    ellipsis: str
    negations: tuple[str, ...]
    escalation: tuple[tuple[str, float], ...] = lx.ESCALATION_15
    consistent: str | None = None
    double_hits: bool = False
    density_weight: str = "combined"
    probability_prefix: str = "prob="
    signals: tuple[str, ...] = field(default=("keyword", "resolution_time", "keyword_density", "classifier"))


FULL = Style(
    FULL_TIERS, FULL_CRISIS, FULL_ALARM,
    "Escalation keyword '{keyword}' detected. ",
    "No standard escalation keyword — polite framing may obscure true impact. ",
    "[none detected]", 60, "...", lx.NEGATIONS_9,
    density_weight="combined escalation+negation score", probability_prefix="mismatch_prob=",
)
BATCH = Style(
    BATCH_TIERS, BATCH_CRISIS, BATCH_ALARM,
    "Escalation keyword '{keyword}' found in ticket text. ",
    "No standard escalation keywords detected -- polite framing may obscure true impact. ",
    "[none detected]", 80, "…", lx.NEGATIONS_7, lx.ESCALATION_13, BATCH_CONSISTENT, double_hits=True,
    signals=("keyword", "resolution_time", "rule_nlp", "classifier"),
)
INTERACTIVE = Style(
    INTERACTIVE_TIERS, INTERACTIVE_CRISIS, INTERACTIVE_ALARM,
    "Keyword '{keyword}' detected. ", "Polite framing masks severity. ",
    "[none]", 60, "...", lx.NEGATIONS_11,
)
STYLES = {"full": FULL, "batch": BATCH, "interactive": INTERACTIVE}


def fill(template: str, values: dict[str, Column]) -> Column:
    """Replace each {name} in the template by the column of that name."""
    parts = [values[piece[1:-1]] if piece.startswith("{") else F.lit(piece)
             for piece in re.split(r"(\{\w+\})", template) if piece]
    return F.concat(*parts)


def shortest(density: Column) -> Column:
    """Four-digit number without superfluous zeros, as in 0.05 or 0.0."""
    return F.regexp_replace(fixed(density, 4), r"(\.\d+?)0+$", "$1")


def tier_message(style: Style, tier: Column, minutes: Column, cuts: tuple[Column, Column, Column]) -> Column:
    values = {
        "rt1": fixed(minutes, 1), "rt0": fixed(minutes, 0),
        "p25": fixed(cuts[0], 0), "p50": fixed(cuts[1], 0), "p75": fixed(cuts[2], 0),
    }
    message = None
    for label, template in style.tiers.items():
        text = fill(template, values)
        message = F.when(tier == label, text) if message is None else message.when(tier == label, text)
    return message


@dataclass(frozen=True)
class Evidence:
    """Columns of one flat evidence record."""

    severity_delta: Column
    mismatch_type: Column
    top_keyword: Column
    keyword_weight: Column
    keyword_density: Column
    resolution_tier: Column
    resolution_note: Column
    constraint_analysis: Column
    confidence: Column
    signals: Column


def evidence(
    style: Style, *, subject: Column, description: Column, assigned: Column, inferred: Column, predicted: Column,
    probability: Column, minutes: Column, hits: Column, words: Column, cuts: tuple[Column, Column, Column],
) -> Evidence:
    """Everything an evidence record states about one ticket.

    `words` is the word count of the joined text, `cuts` the three tier limits.
    """
    delta = severity_number(inferred) - severity_number(assigned)
    kind = mismatch_type(F.lit(1), delta, probability)
    keyword, weight = top_phrase(hits, style.escalation)
    if style.double_hits:
        density = density_double_hits(hits, words, style.escalation, style.negations)[0]
    else:
        density = density_weighted(hits, words, style.escalation, style.negations)
    density = round_exact(density, 4)
    tier = resolution_tier(minutes, *cuts)
    note = tier_message(style, tier, minutes, cuts)

    values = {
        "subject": F.substring(or_empty(subject), 1, style.subject_chars), "inferred": inferred, "assigned": assigned,
        "gap": F.abs(delta).cast("string"), "rt0": fixed(minutes, 0), "rt": minutes.cast("string"), "tier": tier,
        "density4": fixed(density, 4), "excerpt": snippet(or_empty(description), 120, style.ellipsis),
        "density_note": F.when(density > 0.05, "is elevated but ").otherwise("is low and "),
        "keyword_note": F.when(keyword.isNull(), style.keyword_missing).otherwise(
            fill(style.keyword_found, {"keyword": F.coalesce(keyword, F.lit(""))})),
    }
    analysis = F.when(kind == "Hidden Crisis", fill(style.crisis, values)).otherwise(fill(style.alarm, values))
    if style.consistent:
        analysis = F.when(predicted == 1, analysis).otherwise(fill(style.consistent, values))

    none = F.lit(None).cast("string")
    confidence = percent(probability)
    rule = density_label(density)
    if style.double_hits:
        density_entry = (F.concat(rule, F.lit(" (density="), fixed(density, 4), F.lit(")")),
                         fixed(severity_number(rule), 1))
        model_value = F.concat(F.lit("mismatch="), predicted.cast("string"))
        shown_minutes = minutes.cast("string")
    else:
        density_entry = (shortest(density), F.lit(style.density_weight))
        model_value = F.concat(F.lit(style.probability_prefix), fixed(probability, 3))
        shown_minutes = fixed(minutes, 0)
    entries = (
        (F.coalesce(keyword, F.lit(style.nothing)), fixed(weight, 1), none),
        (F.concat(shown_minutes, F.lit(" min")), none, note),
        (*density_entry, none),
        (model_value, confidence, none),
    )
    signals = F.array(*[
        F.struct(F.lit(name).alias("signal"), value.alias("value"), w.alias("weight"), text.alias("interpretation"))
        for name, (value, w, text) in zip(style.signals, entries)
    ])
    shown_kind = F.when(predicted == 1, kind).otherwise("None")
    return Evidence(delta, shown_kind, keyword, weight, density, tier, note, analysis, confidence, signals)
