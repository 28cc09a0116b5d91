"""Whole-word phrase matching in one pass over the text.

A ticket is searched once for the union of all lexicons. The result is a small
array column holding every phrase occurrence; each signal then looks at that
array and never at the text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from .lexicons import ALL_PHRASES
from .text import WORD


def _prefix_pattern(phrases: Iterable[str]) -> str:
    """Alternation of the phrases that shares common prefixes, longest first."""
    by_head: dict[str, list[str]] = {}
    ends_here = False
    for phrase in phrases:
        if phrase:
            by_head.setdefault(phrase[0], []).append(phrase[1:])
        else:
            ends_here = True
    branches = [re.escape(head) + _prefix_pattern(tails) for head, tails in sorted(by_head.items())]
    if ends_here:
        branches.append("")
    if len(branches) == 1:
        return branches[0]
    return "(?:" + "|".join(branches) + ")"


def _contained_at_start(phrase: str, phrases: Sequence[str]) -> list[str]:
    """Other phrases that also match, as whole words, where `phrase` starts."""
    return [p for p in phrases
            if p != phrase and phrase.startswith(p) and not (phrase[len(p)].isalnum() or phrase[len(p)] == "_")]


def phrase_hits(text: Column, phrases: Sequence[str] = ALL_PHRASES) -> Column:
    """Every whole-word occurrence of every phrase, as array<string>.

    The lookahead leaves the search at each word start, so phrases that overlap
    are all found; shorter phrases starting at the same word are added back.
    """
    for phrase in phrases:
        first, last = phrase[:1], phrase[-1:]
        if not (first.isalnum() and last.isalnum()):
            raise ValueError(f"phrase must start and end with a word character: {phrase!r}")
    pattern = f"(?<!{WORD})(?=({_prefix_pattern(phrases)})(?!{WORD}))"
    longest = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    nested = {p: inner for p in phrases if (inner := _contained_at_start(p, phrases))}
    if not nested:
        return longest

    def expand(hit: Column) -> Column:
        value = None
        for phrase, inner in nested.items():
            found = text_array((phrase, *inner))
            value = F.when(hit == phrase, found) if value is None else value.when(hit == phrase, found)
        return value.otherwise(F.array(hit))

    # Most texts hold no nested phrase; those keep the array as it is.
    return F.when(any_hit(longest, nested), F.flatten(F.transform(longest, expand))).otherwise(longest)


def text_array(values: Iterable[str]) -> Column:
    """Constant array<string>."""
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(hit: Column, phrases: Iterable[str]) -> Column:
    return F.array_contains(text_array(phrases), hit)


def any_hit(hits: Column, phrases: Iterable[str]) -> Column:
    return F.arrays_overlap(hits, text_array(phrases))


def present(hits: Column, phrase: str) -> Column:
    return F.array_contains(hits, phrase)


def distinct_hits(hits: Column, phrases: Sequence[str]) -> Column:
    """How many different phrases of the set occur."""
    return F.size(F.array_intersect(hits, text_array(phrases)))


def total_hits(hits: Column, phrases: Sequence[str]) -> Column:
    """How often phrases of the set occur, repeats included."""
    return F.size(F.filter(hits, lambda hit: _in(hit, phrases)))


def weighted_hits(hits: Column, weighted: Sequence[tuple[str, float]]) -> Column:
    """Occurrences times weight as doubles, added up in the order of the list."""
    listed = F.expr("array(" + ", ".join(
        f"named_struct('phrase', {sql_text(phrase)}, 'weight', {float(weight)!r}D)" for phrase, weight in weighted) + ")")

    def add(total: Column, item: Column) -> Column:
        return total + F.size(F.filter(hits, lambda hit: hit == item["phrase"])) * item["weight"]

    # A null array has no hits; most texts have none of the list.
    phrases = [phrase for phrase, _ in weighted]
    return F.when(any_hit(hits, phrases), F.aggregate(listed, F.lit(0.0), add)).otherwise(F.lit(0.0))


def top_phrase(hits: Column, weighted: Sequence[tuple[str, float]]) -> tuple[Column, Column]:
    """Heaviest phrase present and its weight; the earlier listed one wins ties."""
    phrase_col = weight_col = None
    for phrase, weight in sorted(weighted, key=lambda item: -item[1]):
        found = present(hits, phrase)
        if phrase_col is None:
            phrase_col, weight_col = F.when(found, F.lit(phrase)), F.when(found, F.lit(weight))
        else:
            phrase_col, weight_col = phrase_col.when(found, F.lit(phrase)), weight_col.when(found, F.lit(weight))
    return phrase_col, weight_col.otherwise(F.lit(0.0))
