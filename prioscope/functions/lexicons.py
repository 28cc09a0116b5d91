"""Word lists used by the severity signals.

Fixed values: the phrases, their order and their weights decide the results and
therefore equal the published definition of each signal, variant by variant.
"""

from __future__ import annotations

# --- Fixed values: tiered severity phrases (signal 1) -----------------------
TIER_CRITICAL = (
    "data loss", "data breach", "security breach", "system down",
    "production down", "ransomware", "hacked", "complete outage",
    "cannot access", "service unavailable", "data corruption",
)
TIER_HIGH = (
    "not working", "failure", "emergency", "broken", "outage",
    "urgent", "escalate", "sla", "major issue", "access denied",
    "payment failed", "billing error", "cannot login", "crash",
    "crashing", "crashes",
)
TIER_MEDIUM = (
    "error", "failed", "incorrect", "wrong", "missing",
    "problem", "issue", "bug", "not loading", "spinning",
    "slow", "delay", "not syncing", "update", "upgrade",
)
TIER_LOW = (
    "question", "inquiry", "how do i", "how to", "where is",
    "information", "request", "feedback", "feature", "suggestion",
    "status", "update me", "let me know",
)
# The shorter variant of the tiers lacks these phrases.
TIER_SHORT_OMITS = ("update", "upgrade", "update me")
TIER_NEGATIONS = (
    "not", "never", "no", "unable", "cannot", "can't",
    "won't", "doesn't", "didn't", "don't",
)

# --- Fixed values: weighted escalation phrases (signal 4 and evidence) ------
ESCALATION_16 = (
    ("data loss", 3.0), ("outage", 3.0), ("emergency", 3.0), ("cannot access", 2.8),
    ("failure", 2.5), ("not working", 2.5), ("critical", 2.5), ("sla", 2.3),
    ("escalate", 2.3), ("broken", 2.0), ("down", 2.0), ("urgent", 2.0),
    ("immediately", 1.8), ("error", 1.2), ("problem", 1.0), ("issue", 0.8),
)
ESCALATION_15 = ESCALATION_16[:15]
ESCALATION_13 = ESCALATION_16[:13]

NEGATIONS_11 = (
    "not", "never", "no", "unable", "can't", "won't", "doesn't",
    "didn't", "don't", "isn't", "wasn't",
)
NEGATIONS_9 = NEGATIONS_11[:9]
NEGATIONS_7 = NEGATIONS_11[:7]

# --- Fixed values: classifier text features ---------------------------------
FEATURE_ESCALATION = (
    "urgent", "emergency", "outage", "failure", "not working",
    "cannot access", "data loss", "broken", "critical", "sla",
    "escalate", "immediately", "down", "crash", "error", "wrong",
)

# --- Fixed values: content phrases of the rule override ---------------------
CRITICAL_CONTENT = (
    "inaccessible", "gone", "cannot access", "production down", "database",
    "data loss", "security breach", "unauthorized", "all users", "entire system",
    "no access", "not working", "records gone", "payment", "compromised",
    "revenue loss", "all transactions", "complete outage", "cannot log",
)
TRIVIAL_CONTENT_32 = (
    "font", "color", "colour", "tooltip", "spacing", "alignment", "icon", "typo",
    "date format", "profile picture", "button color", "helvetica", "arial",
    "favicon", "label", "placeholder", "logo", "pixel", "pixels", "too far",
    "spelling", "subject line", "welcome email", "slightly", "darker blue",
    "punctuation", "formatting", "indent", "thumbnail", "banner", "css", "padding",
)
TRIVIAL_CONTENT_45 = TRIVIAL_CONTENT_32 + (
    "too left", "too right", "brand image", "company logo", "5 pixels",
    "few pixels", "lighter", "shade", "background color", "margin",
    "border-radius", "font-size", "font size",
)

ALL_PHRASES = tuple(sorted({
    *TIER_CRITICAL, *TIER_HIGH, *TIER_MEDIUM, *TIER_LOW, *TIER_NEGATIONS,
    *(phrase for phrase, _ in ESCALATION_16), *NEGATIONS_11, *FEATURE_ESCALATION,
    *CRITICAL_CONTENT, *TRIVIAL_CONTENT_45,
}))
