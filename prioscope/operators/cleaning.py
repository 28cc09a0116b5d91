"""From raw to clean tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..functions.durations import parse_minutes
from ..functions.severity import clean_priority, severity_number
from ..functions.text import or_empty, strip
from .statistics import with_row_index

UNKNOWN_CHANNEL = "Unknown"
DEFAULT_CHANNEL = "Email"
INPUT_TEXT_CHARS = 400


def drop_incomplete(df: DataFrame, required: Sequence[str] = ("description", "priority_raw")) -> DataFrame:
    """Drop rows where a required value is null; blank text stays."""
    return df.dropna(subset=list(required))


def dropped_rows(df: DataFrame, required: Sequence[str] = ("description", "priority_raw")) -> DataFrame:
    """One row: rows before, dropped and kept."""
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    return df.agg(
        F.count("*").alias("rows_before"), F.count_if(missing).alias("rows_dropped"),
        F.count_if(~missing).alias("rows_kept"),
    )


def strip_strings(df: DataFrame) -> DataFrame:
    """Strip every string column in one projection."""
    return df.select(*[
        strip(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def channel_or_default(channel: Column | None, default: str) -> Column:
    return F.lit(default) if channel is None else F.coalesce(channel, F.lit(default))


def clean_tickets(df: DataFrame, default_unit: str = "minutes") -> DataFrame:
    """Canonical tickets ready for scoring.

    Incomplete rows go, strings are stripped, null subjects become empty, the
    priority gets its label and number, null channels become Unknown and the
    resolution time becomes minutes (null where unreadable).
    """
    kept = strip_strings(drop_incomplete(df))
    return kept.withColumns({
        "subject": or_empty(F.col("subject")),
        "channel": channel_or_default(F.col("channel"), UNKNOWN_CHANNEL),
        "assigned_priority": clean_priority(F.col("priority_raw")),
        "assigned_num": severity_number(F.col("priority_raw")),
        "resolution_minutes": parse_minutes(F.col("resolution_raw"), default_unit),
    })


def with_ticket_id(df: DataFrame, candidates: Sequence[str], order_key: str, out: str = "ticket_id") -> DataFrame:
    """First non-blank candidate id, else ROW-<position in the order of an integer key>."""
    indexed = with_row_index(df, order_key)
    row_name = F.format_string("ROW-%04d", F.col("row_index"))
    ids = [F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in candidates]
    return indexed.withColumn(out, F.coalesce(*ids, row_name))


def with_content_id(df: DataFrame, columns: Sequence[str], out: str = "ticket_id") -> DataFrame:
    """Key for tables without an id or order: a hash of the content."""
    content = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns])
    return df.withColumn(out, F.coalesce(F.nullif(F.col(out), F.lit("")), F.concat(F.lit("ROW-"), F.md5(content)))
                         if out in df.columns else F.concat(F.lit("ROW-"), F.md5(content)))


def model_input_text(subject: Column, description: Column, channel: Column, minutes: Column) -> Column:
    """Tagged one-line text of a ticket; the description part holds 400 characters."""
    return F.concat(
        F.lit("[SUBJECT] "), or_empty(subject),
        F.lit(" [DESC] "), F.substring(or_empty(description), 1, INPUT_TEXT_CHARS),
        F.lit(" [CHANNEL] "), or_empty(channel),
        F.lit(" [RESTIME] "), minutes.cast("string"),
    )
