"""Finding ticket columns by name fragments and renaming them to one schema."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# For each role, fragment sets in order of preference.
TRAINING_ROLES = {
    "subject": [("subject",)],
    "description": [("description",)],
    "priority_raw": [("priority",), ("level",)],
    "channel": [("channel",)],
    "category": [("type",), ("category",)],
    "resolution_raw": [("resolution", "minute"), ("resolution", "hour"), ("resolution", "time")],
    "ticket_id": [("ticket", "id"), ("_id",)],
}
BATCH_ROLES = {
    **TRAINING_ROLES,
    "priority_raw": [("priority",), ("assigned",)],
    "resolution_raw": [("resolution", "minute"), ("resolution", "time"), ("resolution",)],
}
# Scoring finds its columns as training does and needs no priority.
PROFILES = {"training": TRAINING_ROLES, "scoring": TRAINING_ROLES, "batch": BATCH_ROLES}
REQUIRED = {
    "training": ("description", "priority_raw"),
    "scoring": ("subject", "description"),
    "batch": ("subject", "description", "priority_raw"),
}
ID_NAMES = ("ticketid", "id")


def find_column(columns: Sequence[str], *fragments: str) -> str | None:
    """First column whose name holds all fragments, whatever the case."""
    for column in columns:
        if all(fragment.lower() in column.lower() for fragment in fragments):
            return column
    return None


def resolve_columns(
    columns: Sequence[str], profile: str = "training", required: Sequence[str] | None = None,
) -> dict[str, str]:
    """Role to column name; raises when a required role has no column."""
    found = {}
    for role, chain in PROFILES[profile].items():
        match = next((c for fragments in chain if (c := find_column(columns, *fragments))), None)
        if role == "ticket_id":
            # An exact name wins over fragments, whatever its separators.
            exact = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in reversed(columns)}
            match = next((exact[name] for name in ID_NAMES if name in exact), match)
        if match:
            found[role] = match
    missing = [role for role in (REQUIRED[profile] if required is None else required) if role not in found]
    if missing:
        raise ValueError(f"no column for {missing} among {list(columns)}")
    return found


def to_tickets(df: DataFrame, profile: str = "training", required: Sequence[str] | None = None,
               keep: Sequence[str] = ()) -> DataFrame:
    """The canonical ticket columns, as far as present; absent optional ones are null.

    `keep` lists further columns to carry along.
    """
    found = resolve_columns(df.columns, profile, required)
    columns = [
        (F.col(f"`{found[role]}`") if role in found else F.lit(None).cast("string")).alias(role)
        for role in PROFILES[profile]
    ]
    return df.select(*columns, *keep)
