"""Column functions on hand-made rows; expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from prioscope.functions import lexicons as lx
from prioscope.functions.durations import first_token_number, parse_minutes, to_number
from prioscope.functions.matching import distinct_hits, phrase_hits, sql_text, top_phrase, total_hits, weighted_hits
from prioscope.functions.rules import combine, rule_override
from prioscope.functions.severity import (
    clean_priority, density_label, fuse_ceil_mean, fuse_majority, mismatch_type, quartile_severity, resolution_tier,
    severity_from_probability, severity_number, tiered_severity,
)
from prioscope.functions.text import joined_text, snippet, strip, tokens, with_bigrams, word_count


def evaluate(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_parse_minutes(spark):
    cases = {
        "1:02:03": 62.05, "12:30:15": 750.25, "2 days": 2880.0, "2 days 3 hours": 2880.0, "3 hours": 180.0,
        "1.5 Hours": 90.0, "45": 45.0, "  45 ": 45.0, "unknown": None, "": None, ".": None, "1.2.3": None,
        "about 7 days": 10080.0, None: None, "0": 0.0, " 1:00:30": 60.5,
    }
    got = evaluate(spark, [(k,) for k in cases], "x string", m=parse_minutes(F.col("x")))
    assert [g[0] for g in got] == [pytest.approx(v) if v is not None else None for v in cases.values()]
    hours = evaluate(spark, [("45",), ("2 days",)], "x string", m=parse_minutes(F.col("x"), "hours"))
    assert hours == [(2700.0,), (2880.0,)]


def test_numbers(spark):
    cases = {"12": 12.0, " 1e3 ": 1000.0, "12 hours": None, "12d": None, "nan": None, "": None, "-.5": -0.5, None: None}
    assert [g[0] for g in evaluate(spark, [(k,) for k in cases], "x string", n=to_number(F.col("x")))] == list(cases.values())
    tokens_ = {"12 hours": 12.0, "5:30:15": None, "unknown": None, " 7 x": 7.0}
    assert [g[0] for g in evaluate(spark, [(k,) for k in tokens_], "x string", n=first_token_number(F.col("x")))] == list(tokens_.values())


def test_strip_and_words(spark):
    rows = [("  a b 　",), ("\t\n",), ("",), (None,), ("a  b\nc",)]
    got = evaluate(spark, rows, "x string", s=strip(F.col("x")), w=word_count(F.col("x")))
    assert got == [("a b", 2), ("", 0), ("", 0), (None, 0), ("a  b\nc", 3)]


def test_snippet(spark):
    got = evaluate(spark, [("x" * 120,), ("x" * 121,)], "x string", s=snippet(F.col("x"), 120))
    assert got == [("x" * 120,), ("x" * 120 + "...",)]


def hits_of(spark, text):
    return evaluate(spark, [(text,)], "x string", h=phrase_hits(F.lower(F.col("x"))))[0][0]


@pytest.mark.parametrize("text, expected", [
    ("not working", ["not", "not working"]),
    ("It is NOT, not and not!", ["not", "not", "not"]),
    ("crashing crashes crash", ["crash", "crashes", "crashing"]),
    ("crashed failures", []),
    ("I can't and cannot access it", ["can't", "cannot", "cannot access"]),
    ("énot not", ["not"]),
    ("_not not_", []),
    ("no access to no one", ["no", "no", "no access"]),
    ("font size font-size", ["font", "font", "font size", "font-size"]),
    ("the billing error", ["billing error", "error"]),
    ("data loss,data breach", ["data breach", "data loss"]),
    ("", []),
])
def test_phrase_hits(spark, text, expected):
    assert sorted(hits_of(spark, text)) == expected


def test_hits_equal_one_search_per_phrase(spark, small):
    """The single pass against one regular expression per phrase, on all composed tickets."""
    from prioscope.plans import catalog
    df = catalog.matched(spark, small).withColumn("txt", joined_text(F.col("subject"), F.col("description")))
    wrong = [F.count_if(F.expr(f"size(filter(hits, h -> h = {sql_text(p)}))")
                        != F.regexp_count("txt", F.lit(rf"(?U)\b{p}\b"))).alias(str(i))
             for i, p in enumerate(lx.ALL_PHRASES)]
    assert set(df.agg(*wrong).first()) == {0}


def test_counts(spark):
    rows = [("data loss error error not now",)]
    hits = phrase_hits(F.col("x"))
    got = evaluate(spark, rows, "x string",
                   w=weighted_hits(hits, lx.ESCALATION_16), n=total_hits(hits, lx.NEGATIONS_11),
                   d=distinct_hits(hits, [p for p, _ in lx.ESCALATION_16]),
                   k=top_phrase(hits, lx.ESCALATION_15)[0], kw=top_phrase(hits, lx.ESCALATION_15)[1])
    assert got == [(pytest.approx(5.4), 1, 2, "data loss", 3.0)]


def test_weights_add_up_in_the_order_of_the_list(spark):
    # As doubles 0.1 + 0.2 + 0.3 is not 0.6; the order of the text does not matter.
    listed = [("one", 0.1), ("two", 0.2), ("three", 0.3)]
    hits = phrase_hits(F.col("x"), [p for p, _ in listed])
    got = evaluate(spark, [("three two one",), ("two, two",), ("none",), (None,)], "x string", w=weighted_hits(hits, listed))
    assert got == [(0.1 + 0.2 + 0.3,), (2 * 0.2,), (0.0,), (0.0,)]


def test_top_phrase_ties_and_none(spark):
    hits = phrase_hits(F.col("x"))
    phrase, weight = top_phrase(hits, lx.ESCALATION_15)
    got = evaluate(spark, [("emergency and outage",), ("urgent, broken",), ("hello",)], "x string", p=phrase, w=weight)
    assert got == [("outage", 3.0), ("broken", 2.0), (None, 0.0)]


@pytest.mark.parametrize("text, expected", [
    ("there was a data loss", "Critical"), ("urgent outage", "High"), ("urgent outage not ok", "Critical"),
    ("urgent", "High"), ("urgent, never ok", "High"), ("an error", "Medium"), ("error and bug", "Medium"),
    ("no error", "High"), ("a question", "Low"), ("hello", "Low"), ("w " * 15, "Low"), ("w " * 16, "Medium"),
    ("w " * 80, "Medium"), ("w " * 81, "High"), ("please update", "Medium"), ("update me", "Medium"),
])
def test_tiered_severity(spark, text, expected):
    label = tiered_severity(phrase_hits(F.col("x")), word_count(F.col("x")))
    assert evaluate(spark, [(text,)], "x string", s=label) == [(expected,)]


def test_tiered_severity_short(spark):
    label = tiered_severity(phrase_hits(F.col("x")), word_count(F.col("x")), short_tiers=True)
    assert evaluate(spark, [("please update",), ("an error",)], "x string", s=label) == [("Low",), ("Medium",)]


def test_priority(spark):
    rows = [("Low",), (" hIGH ",), ("CRITICAL",), ("P1",), (None,), ("",)]
    got = evaluate(spark, rows, "x string", n=severity_number(F.col("x")), l=clean_priority(F.col("x")))
    assert got == [(1, "Low"), (3, "High"), (4, "Critical"), (2, "Medium"), (2, "Medium"), (2, "Medium")]


def test_thresholds_are_strict(spark):
    rows = [(0.08,), (0.0801,), (0.05,), (0.051,), (0.02,), (0.021,)]
    got = evaluate(spark, rows, "x double", l=density_label(F.col("x")))
    assert [g[0] for g in got] == ["High", "Critical", "Medium", "High", "Low", "Medium"]
    cuts = [F.lit(v) for v in (1.0, 2.0, 3.0)]
    rows = [(0.5,), (1.0,), (2.0,), (3.0,), (3.5,), (None,)]
    got = evaluate(spark, rows, "x double", t=resolution_tier(F.col("x"), *cuts), q=quartile_severity(F.col("x"), *cuts))
    assert [g[0] for g in got] == ["Low", "Low", "Medium", "High", "Critical", "Unknown"]
    assert [g[1] for g in got][:5] == ["Low", "Medium", "High", "Critical", "Critical"]


def test_fusion(spark):
    rows = [(a, b) for a in range(1, 5) for b in range(1, 5)]
    got = evaluate(spark, rows, "a int, b int", f=fuse_ceil_mean(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [-(-(a + b) // 2) for a, b in rows]
    rows = [(1, 2, 2, 3), (1, 2, 3, 4), (4, 1, 1, 4), (3, 3, 3, 1)]
    got = evaluate(spark, rows, "a int, b int, c int, d int", f=fuse_majority([F.col(c) for c in "abcd"]))
    assert [g[0] for g in got] == [2, 1, 4, 3]


def test_probability_and_type(spark):
    rows = [(0, 0.9), (1, 0.81), (1, 0.80), (1, 0.66), (1, 0.65), (1, 0.5)]
    fallback = F.lit("Low")
    got = evaluate(spark, rows, "p int, x double",
                   b=severity_from_probability(F.col("p"), F.col("x"), fallback),
                   i=severity_from_probability(F.col("p"), F.col("x"), fallback, True))
    assert [g[0] for g in got] == ["Low", "Critical", "High", "High", "Medium", "Medium"]
    assert [g[1] for g in got] == ["Low", "Critical", "High", "High", "Medium", "Low"]
    rows = [(1, 1, 0.1), (1, -1, 0.9), (1, 0, 0.5), (1, 0, 0.49), (0, 2, 0.9)]
    got = evaluate(spark, rows, "p int, d int, x double", a=mismatch_type(F.col("p"), F.col("d"), F.col("x")),
                   b=mismatch_type(F.col("p"), F.col("d"), None))
    assert [g[0] for g in got] == ["Hidden Crisis", "False Alarm", "Hidden Crisis", "False Alarm", "None"]
    assert [g[1] for g in got] == ["Hidden Crisis", "False Alarm", "Hidden Crisis", "Hidden Crisis", "None"]


def test_rule_override(spark):
    rows = [
        (1, 3, 0, 180.0, 0.0), (2, 1, 0, 61.0, 0.0), (2, 1, 0, 60.0, 0.0), (4, 0, 3, 5.0, 0.0), (3, 0, 1, 29.9, 0.0),
        (1, 0, 4, 7.0, 0.0), (1, 0, 0, 91.0, 0.04), (1, 0, 0, 90.0, 0.04), (3, 5, 0, 500.0, 0.9), (1, 9, 0, 400.0, 0.0),
    ]
    outcome = rule_override(*[F.col(c) for c in ("pri", "crit", "triv", "rt", "d")])
    got = evaluate(spark, rows, "pri int, crit int, triv int, rt double, d double", n=outcome.name, p=outcome.probability)
    expected = [("hidden_crisis", 0.95), ("hidden_crisis", 0.752), (None, None), ("false_alarm", 0.9), ("false_alarm", 0.7),
                ("trivial_multi", 0.9), ("density_rt", 0.62), (None, None), (None, None), ("hidden_crisis", 0.95)]
    assert [(n, p if p is None else round(p, 9)) for n, p in got] == expected


def test_combine(spark):
    rows = [(0.5, 0.9), (0.7, None), (0.5, 0.4), (0.5, None), (0.3, 0.2), (0.9, 0.7)]
    for mode, expected in {
        "evaluation": [(1, .9, "rule"), (1, .7, "ml"), (1, .45, "combined"), (0, .25, "combined"), (0, .25, "combined"), (1, .9, "ml")],
        "interactive": [(1, .9, "rule"), (1, .7, "ml"), (1, .45, "combined"), (1, .5, "combined"), (0, .25, "combined"), (1, .9, "ml")],
        "stronger": [(1, .9, "rule"), (1, .7, "ml"), (0, .5, "ml"), (0, .5, "ml"), (0, .3, "ml"), (1, .9, "ml")],
    }.items():
        out = combine(mode, F.col("m"), F.col("r"), F.lit(0.64))
        got = evaluate(spark, rows, "m double, r double", a=out.predicted, b=out.probability, c=out.source)
        assert [(a, round(b, 9), c) for a, b, c in got] == expected, mode
    with pytest.raises(ValueError):
        combine("other", F.col("m"), F.col("r"), F.lit(0.5))


def test_tokens(spark):
    got = evaluate(spark, [("A big-Dog's dog_1 é ça",), ("x",), (None,)], "x string",
                   t=tokens(F.col("x")), b=with_bigrams(tokens(F.col("x"))))
    assert got[0][0] == ["big", "dog", "dog_1", "ça"]
    assert got[0][1] == ["big", "dog", "dog_1", "ça", "big dog", "dog dog_1", "dog_1 ça"]
    assert got[1] == ([], []) and got[2] == ([], [])
