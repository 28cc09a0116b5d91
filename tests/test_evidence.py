"""Evidence texts written out in full, in all three wordings."""

import pytest

from prioscope.operators.dossiers import dossier_examples, dossiers
from prioscope.operators.signals import with_phrase_hits

SCHEMA = ("ticket_id string, subject string, description string, assigned_priority string, inferred_severity string, "
          "predicted_label int, prob_mismatch double, resolution_minutes double")
ROWS = [
    ("T1", "Down", "There was an outage and it is not ok", "Low", "Critical", 1, 0.9, 200.0),
    ("T2", "Hello", "x" * 130, "Critical", "Low", 1, 0.7, 10.0),
    ("T3", "Same", "fine", "Medium", "Medium", 1, 0.45, None),
    ("T4", "Not flagged", "outage", "Low", "Low", 0, 0.1, 50.0),
]


@pytest.fixture(scope="module")
def tickets(spark):
    return with_phrase_hits(spark.createDataFrame(ROWS, SCHEMA))


def records(tickets, style):
    return {r.ticket_id: r for r in dossiers(tickets, style).collect()}


def test_full(tickets):
    got = records(tickets, "full")
    assert set(got) == {"T1", "T2", "T3"}
    one = got["T1"]
    assert (one.mismatch_type, one.severity_delta, one.confidence) == ("Hidden Crisis", 3, "90.0%")
    # 10 words: outage 3.0, down 2.0, not 1.0.
    assert [tuple(e) for e in one.feature_evidence] == [
        ("keyword", "outage", "3.0", None),
        ("resolution_time", "200 min", None, "200.0 min — top quartile (P75=125 min), complex case."),
        ("keyword_density", "0.6", "combined escalation+negation score", None),
        ("classifier", "mismatch_prob=0.900", "90.0%", None)]
    assert one.constraint_analysis == (
        "Ticket 'Down' describes a Critical-severity issue but was assigned Low — 3 severity level(s) lower. "
        "Escalation keyword 'outage' detected. Resolution time (200 min, Critical tier) corroborates higher severity. "
        'Excerpt: "There was an outage and it is not ok"')
    assert got["T2"].constraint_analysis == (
        "Ticket 'Hello' was assigned Critical but signals infer Low — 3 level(s) lower. Keyword density (0.0000) and "
        "resolution time (10 min, Low tier) are both consistent with Low severity. "
        f'Excerpt: "{"x" * 120}..."')
    assert got["T2"].feature_evidence[0].value == "[none detected]" and got["T2"].feature_evidence[2].value == "0.0"
    # Equal severities: the probability decides; the missing time counts as 60 minutes.
    assert got["T3"].mismatch_type == "False Alarm" and got["T3"].feature_evidence[1].value == "60 min"


def test_batch(tickets):
    one = records(tickets, "batch")["T1"]
    # outage and down count twice each, not by weight: 5 / 10.
    assert [tuple(e) for e in one.feature_evidence] == [
        ("keyword", "outage", "3.0", None),
        ("resolution_time", "200.0 min", None,
         "200.0 min -- top quartile (P75=120 min), indicative of a complex or escalated case."),
        ("rule_nlp", "Critical (density=0.5000)", "4.0", None),
        ("classifier", "mismatch=1", "90.0%", None)]
    assert one.constraint_analysis == (
        "The ticket 'Down' describes a Critical-severity issue yet was assigned Low -- a gap of 3 severity level(s). "
        "Escalation keyword 'outage' found in ticket text. Resolution time (200.0 min, Critical tier) corroborates "
        'severity inference. Excerpt: "There was an outage and it is not ok"')


def test_interactive(tickets):
    one = records(tickets, "interactive")["T2"]
    assert one.constraint_analysis == (
        "'Hello' was assigned Critical but signals infer Low (3 level(s) lower). "
        "Keyword density (0.0000) and RT (10 min) consistent with Low.")
    assert one.feature_evidence[1].interpretation == "10 min — straightforward resolution."
    assert one.feature_evidence[0].value == "[none]" and one.feature_evidence[3].value == "prob=0.700"


def test_examples(tickets):
    got = {r.mismatch_type: r.ticket_id for r in dossier_examples(dossiers(tickets)).collect()}
    assert got == {"Hidden Crisis": "T1", "False Alarm": "T2"}
