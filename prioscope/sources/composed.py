"""Ticket table composed from the `events` table, for the shared test data.

The driver tables hold no tickets; every event becomes one ticket, its texts and
attributes being a function of the event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.matching import sql_text
from .tables import TASK_ROWS

# --- Fixed values: text blocks of the composed tickets ----------------------
SUBJECTS = (
    "Small question for the database page", "Login failed", "URGENT please help now", "Routine check",
    "Feature request", "SLA BREACH", "Billing error", "Hello",
)
PROBLEMS = (
    "we had a data loss last night", "the export is not working", "the page is slow",
    "how do I change my profile picture", "there was an outage and a crash", "the total is incorrect",
    "the font color looks slightly off", "our production database is inaccessible",
    "an emergency failure happened", "the tooltip has a typo", "I need information",
    "the payment failed with an error", "this issue is a problem",
    "the server is down, escalate immediately", "thank you for the nice service",
)
CONTEXTS = (
    "No rush, tell me when it suits", "I can't log in", "Please fix it", "It never worked",
    "We have tried to restart the device and to clear the cache and to read the manual and to ask a friend and then "
    "to wait for one more day but the result stays the same as it was before we started with all of that work",
    "Thanks", "It is critical for all users", "I am unable to use it and it doesn't load",
    "This broke the welcome email banner", "Broken on Monday, broken on Tuesday, still broken", "Not, not and not",
)
PRIORITIES = ("Critical", "High", "Medium", "Low", " high ", "CRITICAL", "low", "P1", None, "Low", "Medium")
CHANNELS = ("Email", "Chat", "Phone", "Web Form", "Social Media", None)
CHANNEL_NAMES = ("Chat", "Email", "Phone", "Social Media", "Unknown", "Web Form")


def _pick(values: tuple, number: Column) -> Column:
    items = ", ".join("NULL" if v is None else sql_text(v) for v in values)
    return F.expr(f"array({items})")[(number % len(values)).cast("int")]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores, and at most about TASK_ROWS rows a task, when the input has fewer splits; else leave it alone."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    if df.rdd.getNumPartitions() < tasks:
        return df.repartition(tasks, key)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def composed_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tickets, one per event: id, number, texts, priority, channel, category, times."""
    events = spread(read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts"),
                    "event_id")
    return tickets_from_events(events)


def tickets_from_events(events: DataFrame) -> DataFrame:
    number, whole = F.col("event_id"), F.floor("value").cast("int")
    description = F.concat(_pick(PROBLEMS, number), F.lit(". "), _pick(CONTEXTS, number))
    kind = number % 6
    duration = (
        F.when(kind == 0, F.concat(whole.cast("string"), F.lit(" hours")))
        .when(kind == 1, F.concat((whole % 9).cast("string"), F.lit(" days")))
        .when(kind == 2, F.concat((whole % 24).cast("string"), F.lit(":30:15")))
        .when(kind == 3, whole.cast("string"))
        .when(kind == 4, "unknown")
    )
    return events.select(
        F.concat(F.lit("T"), number.cast("string")).alias("ticket_id"),
        number.alias("ticket_num"),
        _pick(SUBJECTS, number).alias("ticket_subject"),
        F.when(number % 97 != 0, description).alias("ticket_description"),
        _pick(PRIORITIES, number * 7 + F.col("user_id")).alias("priority_level"),
        _pick(CHANNELS, F.col("user_id")).alias("ticket_channel"),
        F.col("event_type").alias("issue_category"),
        duration.alias("resolution_time"),
        (F.col("value") / 10).alias("resolution_time_hours"),
        F.col("ts").alias("submitted_at"),
    )
