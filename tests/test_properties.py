"""Properties that hold for any text; texts are drawn by hypothesis and scored in one Spark job each."""

import math

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from prioscope.functions import lexicons as lx
from prioscope.functions.rounding import round_exact
from prioscope.operators.signals import density_signal, tier_signal, with_phrase_hits

WORDS = st.sampled_from([*lx.ALL_PHRASES, "hello", "the", "NOT", "énot", "x_no", ",", "...", "\n"])
TEXTS = st.lists(st.lists(WORDS, max_size=12).map(" ".join), min_size=20, max_size=40)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=TEXTS)
def test_scores_of_any_text(spark, texts):
    rows = [(i, "s", t) for i, t in enumerate(texts)] + [(i + len(texts), "s", f"{t} data loss") for i, t in enumerate(texts)]
    df = with_phrase_hits(spark.createDataFrame(rows, "i int, subject string, description string"))
    scored = {r.i: r for r in density_signal(tier_signal(df)).collect()}
    for i, text in enumerate(texts):
        plain, loaded = scored[i], scored[i + len(texts)]
        assert plain.raw_density >= 0 and not math.isnan(plain.raw_density)
        assert plain.llm_severity_score in ("Low", "Medium", "High", "Critical")
        assert loaded.llm_severity_score == "Critical"
        assert plain.words == len(f"s {text}".split())
        assert loaded.words == plain.words + 2


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=TEXTS)
def test_hits_equal_separate_searches(spark, texts):
    df = spark.createDataFrame([(t.lower(),) for t in texts], "description string").withColumn("subject", F.lit(""))
    hits = with_phrase_hits(df)
    wrong = [F.count_if(F.size(F.filter("hits", lambda h: h == F.lit(p)))
                        != F.regexp_count("description", F.lit(rf"(?U)\b{p}\b"))).alias(f"c{i}")
             for i, p in enumerate(("not", "not working", "error", "font", "font-size", "can't"))]
    assert set(hits.agg(*wrong).first()) == {0}


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(
    st.floats(allow_nan=False, width=64), st.floats(-1000, 1000), st.integers(-10**6, 10**6).map(lambda n: n / 1000),
    st.integers(-10**6, 10**6).map(lambda n: n / 32), st.integers(-10**5, 10**5).map(lambda n: n / 160)), min_size=300, max_size=400))
def test_rounding_equals_the_exact_one(spark, values):
    values = [*values, 2.675, 0.75625, 0.5, 1.5, 2.5, -0.5, 1e300, 5e-324, 2.0**52 + 0.5, 2.0**40 + 2.0**-12]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", *[round_exact(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2, 4, 8)]).collect()
    for row in got:
        for digits in (0, 1, 2, 4, 8):
            assert row[f"d{digits}"] == round(row.x, digits), (row.x, digits)
