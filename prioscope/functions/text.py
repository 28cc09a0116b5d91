"""Text columns: trimming, joining, word counting and display snippets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rounding import round_exact

# Unicode word characters, and blank space as patterns and as a list.
WORD = r"[\p{L}\p{N}_]"
BLANK = r"[\s\p{Z}\x85\x1c-\x1f]"
NOT_BLANK = r"[^\s\p{Z}\x85\x1c-\x1f]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove blank space of any kind at both ends (SQL trim knows only spaces)."""
    return F.trim(col, F.lit(BLANKS))


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def joined_text(subject: Column, description: Column) -> Column:
    """Lower-cased subject and description, the text every signal reads."""
    return F.lower(F.concat(or_empty(subject), F.lit(" "), or_empty(description)))


def word_count(col: Column) -> Column:
    """Number of blank-separated words; 0 for null or blank text."""
    return F.coalesce(F.regexp_count(col, F.lit(rf"{NOT_BLANK}+")), F.lit(0))


def tokens(col: Column) -> Column:
    """Lower-cased runs of at least two word characters, in order."""
    return F.regexp_extract_all(F.lower(or_empty(col)), F.lit(WORD + "{2,}"), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """The words followed by every pair of neighbours joined by one space."""
    size = F.size(words)
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(size - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(size - 1, F.lit(0))),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )
    return F.concat(words, pairs)


def snippet(col: Column, length: int, ellipsis: str = "...") -> Column:
    """Display form: at most `length` characters, marked when something was cut."""
    cut = F.concat(F.substring(col, 1, length), F.lit(ellipsis))
    return F.when(F.char_length(col) > length, cut).otherwise(col)


def fixed(col: Column, digits: int) -> Column:
    """Number with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", round_exact(col, digits))


def percent(col: Column) -> Column:
    return F.concat(fixed(col * 100, 1), F.lit("%"))
