"""Files, whole runs, saved models, robustness tickets and streams."""

import json

import pytest
from pyspark.sql import functions as F

from prioscope.operators import learned
from prioscope.operators.classifier import Settings, train_classifier
from prioscope.operators.evaluation import keyword_baseline, robustness_score, with_rule_override
from prioscope.operators.signals import with_phrase_hits
from prioscope.plans import audit
from prioscope.sources import tickets as files
from prioscope.sources.composed import composed_tickets
from prioscope.sources.models import load_model
from prioscope.sources.tables import written
from prioscope.sources.tickets import read_tickets_csv
from prioscope.streaming import live

FAST = Settings(trees=3, logistic_iterations=15, svm_iterations=15)
LABELLING = {"cluster_options": {"k": 10, "seeds": (1, 2), "max_iter": 10}, "regression_options": {"trees": 2}}


@pytest.fixture(scope="module")
def raw(spark, small):
    return composed_tickets(spark, small).drop("resolution_time_hours")


@pytest.fixture(scope="module")
def finished(spark, raw, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    return audit.training_run(raw, FAST, folder, **LABELLING), folder


def test_csv_encodings_and_line_breaks(spark, tmp_path):
    text = 'Ticket_Subject,Ticket_Description,Priority_Level\n"café, ""x""","line one\nline two",High\n,plain,Low\n'
    for name, encoding in (("utf8", "utf-8"), ("latin", "latin-1")):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode(encoding))
        rows = files.read_tickets_csv(spark, str(path)).collect()
        assert [tuple(r) for r in rows] == [('café, "x"', "line one\nline two", "High"), (None, "plain", "Low")]


def test_training_run_results(spark, raw, finished):
    run, folder = finished
    labelled = run.labelled
    usable = raw.where("ticket_description IS NOT NULL AND priority_level IS NOT NULL").count()
    assert labelled.count() == usable
    assert labelled.where("abs(severity_delta) > 3 OR mismatch NOT IN (0, 1)").count() == 0
    lows = labelled.select(F.min("fused_num"), F.max("fused_num")).first()
    assert 1 <= lows[0] <= lows[1] <= 4
    assert {r.signal for r in run.ablation.collect()} == {
        "llm_severity_score", "cluster_severity", "regression_severity", "rule_nlp_severity"}
    test = run.training.test_predictions
    assert abs(test.count() - 0.15 * usable) <= 2
    assert test.where("prob_mismatch < 0 OR prob_mismatch > 1").count() == 0
    metrics = run.training.metrics.first()
    majority = max(test.groupBy("true_label").count().collect(), key=lambda r: r["count"])["count"] / test.count()
    assert metrics.test_accuracy >= majority - 0.05
    assert sum(map(sum, metrics.confusion_matrix)) == test.count()
    assert run.training.validation.count() == 4
    summary = run.summary.first()
    assert summary.mismatch_count == run.dossiers.count() == summary.hidden_crisis_count + summary.false_alarm_count
    found, absent = files.read_results(spark, folder)
    assert not absent and found["predictions"].count() == test.count()
    assert found["ablation"].columns == ["signal", "agreement_with_fused"]


def test_results_that_are_absent(spark, tmp_path):
    found, absent = files.read_results(spark, str(tmp_path))
    assert not found and "metrics" in absent


def test_saved_model_scores_the_same(spark, raw, finished):
    run, folder = finished
    tickets = audit.prepare(raw, "batch")
    loaded = load_model(spark, f"{folder}/model")
    assert loaded.threshold == run.training.model.threshold
    columns = ("ticket_id", "prob_logistic", "prob_svm", "prob_trees", "prob_mismatch")
    before = audit.score_tickets(tickets, run.training.model).select(*columns)
    after = audit.score_tickets(tickets, loaded).select(*columns)
    assert before.exceptAll(after).count() == 0
    outside = "prob_mismatch < least(prob_logistic, prob_svm, prob_trees) - 1e-12 OR " \
              "prob_mismatch > greatest(prob_logistic, prob_svm, prob_trees) + 1e-12"
    assert after.where(outside).count() == 0


@pytest.mark.parametrize("style", ["interactive", "batch"])
def test_batch_run(spark, raw, finished, tmp_path, style):
    model = finished[0].training.model
    # A channel no training ticket had is scored as well.
    new = raw.withColumn("ticket_channel", F.lit("Carrier pigeon"))
    audit.batch_run(new, model, str(tmp_path), style)
    predictions = spark.read.parquet(f"{tmp_path}/predictions")
    assert predictions.columns == list(audit.SHORT_PREDICTION_COLUMNS if style == "interactive" else audit.PREDICTION_COLUMNS)
    flagged = predictions.where("predicted_label = 1").count()
    assert predictions.where("(predicted_label = 1) = (mismatch_type = 'None')").count() == 0
    summary = spark.read.json(f"{tmp_path}/dossiers/summary").first()
    assert summary.total_tickets == predictions.count() and summary.mismatch_count == flagged
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/dossiers/dossiers").collect()]
    assert len(lines) == flagged and all(len(d["feature_evidence"]) == 4 for d in lines)


def test_hours_reach_the_stream(spark):
    df = spark.createDataFrame([("d", "Low", "5")], "description string, priority string, Resolution_Time_Hours string")
    assert live.score(df).select("resolution_minutes", "ticket_id").first().resolution_minutes == 300.0


def test_mixed_encodings(spark, tmp_path):
    texts = {"a": ("café", "utf-8"), "b": ("café", "latin-1"), "c": ("odd \ufffd", "utf-8"), "d": ("日本", "utf-8")}
    for name, (text, encoding) in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(f"k,Größe\n{name},{text}\n".encode(encoding))
    got = read_tickets_csv(spark, str(tmp_path / "*.csv"))
    assert got.columns == ["k", "Größe"]
    assert {r[0]: r[1] for r in got.collect()} == {name: text for name, (text, _) in texts.items()}


def test_regression_with_many_categories(spark):
    df = spark.range(200).selectExpr("cast(id as string) AS ticket_id", "concat('text ', id % 7) AS description", "'Chat' AS channel",
                                     "concat('c', id % 60) AS category", "cast(id % 60 as double) AS resolution_minutes")
    rows = learned.regression_signal(df, trees=2).select("regression_severity").distinct().collect()
    assert len(rows) == 4


def test_labels_must_be_two(spark):
    df = spark.createDataFrame([(str(i), 1) for i in range(20)], "ticket_id string, mismatch int")
    with pytest.raises(ValueError):
        train_classifier(df)


def test_missing_channel_and_id_columns(spark):
    df = spark.createDataFrame([("s", "d", " high ", "2 days"), ("s", "e", "P1", None)],
                               "subject string, description string, priority string, resolution_time string")
    rows = audit.prepare(df, "batch").orderBy("description").collect()
    assert [(r.channel, r.assigned_priority, r.resolution_minutes) for r in rows] == [
        ("Email", "High", 2880.0), ("Email", "Medium", None)]
    assert len({r.ticket_id for r in rows}) == 2 and all(r.ticket_id.startswith("ROW-") for r in rows)


# Own tickets: crises told politely, alarms about trifles, and honest ones of both kinds.
ROBUSTNESS = [
    ("R1", "Small favour", "Our database is gone and all users are affected, no rush.", "Low", 180.0, 1),
    ("R2", "Tiny note", "The payment step stopped, revenue loss is growing.", "Medium", 190.0, 1),
    ("R3", "A remark", "There is an outage in one region.", "Low", 100.0, 1),
    ("R4", "URGENT EMERGENCY FAILURE", "The icon has the wrong color and the font is slightly off!", "Critical", 5.0, 1),
    ("R5", "SLA breach, broken!", "A typo in the banner.", "High", 12.0, 1),
    ("R6", "Critical outage", "The database is down, urgent emergency for all users.", "Critical", 300.0, 0),
    ("R7", "Colors", "I would like another color.", "Low", 45.0, 0),
    ("R8", "Question", "How do I change the logo?", "Low", 200.0, 0),
]


def robustness_table(spark):
    schema = "ticket_id string, subject string, description string, priority string, minutes double, expected_mismatch int"
    return spark.createDataFrame(ROBUSTNESS, schema).withColumnsRenamed({"minutes": "resolution_minutes"})


def test_rules_on_robustness_tickets(spark):
    table = robustness_table(spark).withColumn("assigned_num", F.expr(
        "CASE priority WHEN 'Low' THEN 1 WHEN 'High' THEN 3 WHEN 'Critical' THEN 4 ELSE 2 END"))
    ruled = keyword_baseline(with_rule_override(with_phrase_hits(table)))
    judged = written(ruled.withColumn("final_pred", F.col("rule_prob").isNotNull().cast("int")))
    names = {r.ticket_id: r.rule_name for r in judged.collect()}
    assert names == {"R1": "hidden_crisis", "R2": "hidden_crisis", "R3": "density_rt", "R4": "false_alarm",
                     "R5": "false_alarm", "R6": None, "R7": None, "R8": None}
    score = robustness_score(judged).first()
    assert (score.correctly_detected, score.true_detections, score.wrong_detections) == (8, 5, 0)
    assert score.bonus_achieved and score.improvement > 0


def test_robustness_run(spark, finished):
    clean = audit.prepare(robustness_table(spark).drop("expected_mismatch"), "batch").join(
        robustness_table(spark).select("ticket_id", "expected_mismatch"), "ticket_id")
    results, score = audit.robustness_run(clean, finished[0].training.model, finished[1])
    found, absent = files.read_results(spark, finished[1])
    assert not absent and found["robustness/tickets"].count() == len(ROBUSTNESS)
    assert found["robustness/score"].first().threshold_used == finished[0].training.model.threshold
    assert results.count() == score.first().total_tickets == len(ROBUSTNESS)
    assert {r.source for r in results.select("source").collect()} <= {"rule", "ml", "combined"}


@pytest.mark.parametrize("name", ["resolution_time", "Resolution_Time_Hours"])
def test_stream_equals_batch(spark, raw, tmp_path, name):
    source = str(tmp_path / "in")
    raw = raw.withColumnsRenamed({c: name for c in raw.columns if "resolution" in c.lower()})
    raw.repartition(4).write.parquet(source)
    table = spark.read.parquet(source)
    columns = ["ticket_id", "llm_severity_score", "keyword_density", "rule_nlp_severity", "resolution_tier", "rule_name",
               "rule_prob", "severity_delta", "mismatch"]
    stream = live.score(live.ticket_stream(spark, source, table.schema, files_per_trigger=1)).select(*columns)
    for _ in range(2):      # the second start finds nothing new
        live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    # The batch preparation followed by the same operators.
    prepared = with_phrase_hits(audit.prepare(table))
    expected = live.judged(prepared).select(*columns)
    assert prepared.where("resolution_minutes > 60").count() > 0
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0


def test_windowed_counts_equal_batch(spark, raw, tmp_path):
    source = str(tmp_path / "in")
    raw.coalesce(1).write.parquet(source)
    table = spark.read.parquet(source)
    stream = live.windowed_mismatches(live.score(live.ticket_stream(spark, source, table.schema), ["submitted_at"]))
    live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = live.windowed_mismatches(live.score(table, ["submitted_at"]))
    closed = got.agg(F.max("window_end")).first()[0]
    assert got.count() > 0
    assert got.exceptAll(expected).count() == 0
    assert expected.where(F.col("window_end") <= F.lit(closed)).exceptAll(got).count() == 0
