"""DataFrame operators against brute force on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prioscope.functions.severity import LABELS
from prioscope.operators import clustering, dashboards, dossiers, evaluation, features, filling, fusion, latent, statistics
from prioscope.operators.latent import fit_latent
from prioscope.operators.terms import TfidfModel
from prioscope.sources.resolver import find_column, resolve_columns, to_tickets


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0] * 50, [0.0, -1.5, 2.25, 1e-9, 1e12, -7.0, None, float("nan")],
    [random.Random(7).gauss(0, 100) for _ in range(501)], [1.0] * 300 + [2.0] + [1e6] * 99,
])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = statistics.exact_quantiles(df, "x", {"a": 0.25, "b": 0.5, "c": 0.75, "lo": 0.0, "hi": 1.0}).first()
    numbers = [v for v in values if v is not None and not math.isnan(v)]
    assert list(got) == pytest.approx(list(np.percentile(numbers, [25, 50, 75, 0, 100])), rel=1e-12)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert list(statistics.exact_quantiles(df, "x", {"a": 0.5}).collect()[0]) == [None]


def test_quantiles_with_infinity(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, math.inf, 2.0, -math.inf, 3.0)], "x double")
    got = statistics.exact_quantiles(df, "x", {"lo": 0.0, "a": 0.25, "b": 0.5, "c": 0.75, "hi": 1.0}).first()
    assert list(got) == [-math.inf, 1.0, 2.0, 3.0, math.inf]


def test_hot_value_and_sketch(spark):
    """A third of all rows share one value."""
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 5.0D ELSE cast(id as double) END AS x")
    exact = statistics.exact_quantiles(df, "x", statistics.QUARTILES).first()
    values = [5.0 if i % 3 == 0 else float(i) for i in range(30_000)]
    assert list(exact) == pytest.approx(list(np.percentile(values, [25, 50, 75])))
    near = statistics.approximate_quantiles(df, "x", statistics.QUARTILES).first()
    assert list(near) == pytest.approx(list(exact), abs=10)


def test_quantiles_of_a_narrow_column(spark):
    """All values fall into one coarse bucket, some next to each other."""
    values = [1000 + i / 40_000 for i in range(20_000)] + [math.nextafter(1000.1, 2000), 1000.1, 1000.1]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shares = {"a": 0.0, "b": 0.2, "c": 0.25, "d": 0.7501, "e": 1.0}
    got = statistics.exact_quantiles(df, "x", shares).first()
    assert list(got) == pytest.approx(list(np.percentile(values, [100 * s for s in shares.values()])), rel=1e-14)


def test_row_index_with_repeated_sparse_and_null_keys(spark):
    keys = [None, None] + [7] * 300 + [random.Random(i).randrange(-2**62, 2**62) for i in range(200)]
    df = spark.createDataFrame([(k, i % 5) for i, k in enumerate(keys)], "k bigint, x int").repartition(6)
    rows = statistics.with_row_index(df, "k").orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(len(keys)))
    assert [r.k for r in rows] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert statistics.with_row_index(df.limit(0), "k").count() == 0


def test_rows_without_label_or_cluster_stay(spark):
    df = spark.createDataFrame([(str(i), i % 2 if i < 7 else None) for i in range(10)], "ticket_id string, mismatch int")
    assert features.stratified_split(df).count() == 10
    counts = {r.mismatch: r["count"] for r in features.oversample(df).groupBy("mismatch").count().collect()}
    assert counts == {0: 4, 1: 4, None: 4}
    tickets = spark.createDataFrame([(1, 0, 5.0), (2, 1, 9.0), (3, None, 1.0)], "id int, cluster_id int, m double")
    ranked = clustering.rank_clusters(tickets, "time", "m")
    got = {r.id: r.cluster_severity for r in clustering.attach_cluster_severity(tickets, ranked).collect()}
    assert got == {1: "Low", 2: "Medium", 3: "Medium"}


def test_heatmap_keeps_other_channels(spark):
    df = spark.createDataFrame([("a", "Chat", 1), ("a", "Fax", 2), ("a", None, 4)], "category string, channel string, severity_delta int")
    assert [tuple(r) for r in dashboards.delta_heatmap(df, ["Chat"]).collect()] == [("a", 1.0, 3.0)]


def test_too_many_labels_raise(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_LABELS", 3)
    with pytest.raises(ValueError):
        features.fit_label_encoder(spark.range(5).selectExpr("cast(id as string) AS c"), "c", "code")


def test_row_index_across_ranges(spark):
    keys = random.Random(1).sample(range(-500, 500), 200)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.row_index for r in statistics.with_row_index(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_one_row_statistics_must_be_one_row(spark):
    two = spark.range(2).withColumnRenamed("id", "m")
    with pytest.raises(Exception):
        statistics.with_one_row(spark.range(3), two).collect()


def filled(df, fn, raw="x"):
    return [r.out for r in fn(df, raw, "out").orderBy("i").collect()]


def test_filling(spark):
    def table(values):
        return spark.createDataFrame(list(enumerate(values)), "i int, x string")

    assert filled(table(["1", "3", None, "x"]), filling.fill_median) == [1.0, 3.0, 2.0, 2.0]
    sparse = ["12 hours", "unknown", None, "4", "5:30:15"]
    assert filled(table(sparse), filling.fill_first_token_when_sparse) == [12.0, 30.0, 30.0, 4.0, 21.0]
    assert filled(table(["1", "2", "3 h"]), filling.fill_first_token_when_sparse) == [1.0, 2.0, 1.5]
    assert filled(table(["8 h", "x", "4 h"]), filling.fill_first_token_when_empty) == [8.0, 6.0, 4.0]
    assert filled(table(["8 h", "2", "4 h"]), filling.fill_first_token_when_empty) == [2.0, 2.0, 2.0]
    assert filled(table(["a", None]), filling.fill_first_token_when_empty) == [30.0, 30.0]


def test_label_threshold_drops_to_one_when_needed(spark):
    def labels(rows, **kw):
        df = spark.createDataFrame(rows, "fused_num int, assigned_num int")
        return [r.mismatch for r in fusion.label_mismatch(df, **kw).orderBy("fused_num").collect()]

    assert labels([(1, 1), (2, 1), (4, 2)]) == [0, 0, 1]
    assert labels([(1, 1), (2, 1), (3, 2)]) == [0, 1, 1]
    assert labels([(1, 1), (2, 1), (3, 2)], lower_when_none=False) == [0, 0, 0]


def test_attach_signal_defaults_and_does_not_multiply(spark):
    tickets = spark.createDataFrame([("a",), ("b",)], "ticket_id string")
    signal = spark.createDataFrame([("a", "High"), ("a", "High")], "ticket_id string, s string")
    got = fusion.attach_signal(tickets, signal, "s").orderBy("ticket_id").collect()
    assert [(r.ticket_id, r.s) for r in got] == [("a", "High"), ("b", "Medium")]


def test_join_keeps_one_row_per_prediction(spark):
    preds = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "ticket_id string, channel string")
    tickets = spark.createDataFrame([("a", "1", "s"), ("a", "2", "s"), ("b", "3", "t")], "ticket_id string, channel string, subject string")
    got = dossiers.attach_tickets(preds, tickets, ["channel", "subject"]).orderBy("ticket_id").collect()
    assert [(r.ticket_id, r.channel, r.channel_full, r.subject) for r in got] == [
        ("a", "x", "1", "s"), ("b", "y", "3", "t"), ("c", "z", None, None)]


def test_cluster_ranking(spark):
    rows = [(0, 50.0), (1, 10.0), (1, 30.0), (2, 90.0), (3, 20.0)]
    df = spark.createDataFrame(rows, "cluster_id int, resolution_minutes double")
    got = {r.cluster_id: r.cluster_severity for r in clustering.rank_clusters(df).collect()}
    assert got == {1: "Low", 3: "Medium", 0: "High", 2: "Critical"}
    by_size = {r.cluster_id: r.cluster_severity for r in clustering.rank_clusters(df, "size").collect()}
    assert by_size == {1: "Low", 0: "Medium", 2: "High", 3: "Critical"}
    three = {r.cluster_id for r in clustering.rank_clusters(df.where("cluster_id < 3")).collect()}
    assert three == {0, 1, 2}
    with pytest.raises(Exception):
        clustering.rank_clusters(spark.range(5).selectExpr("cast(id as int) cluster_id", "1.0D resolution_minutes")).collect()


def test_split_and_oversampling_are_exact(spark):
    rows = [(f"t{i}", int(i % 9 == 0)) for i in range(1000)] + [("only", 2)]
    df = spark.createDataFrame(rows, "ticket_id string, mismatch int")
    counts = {(r.mismatch, r.split): r["count"] for r in features.stratified_split(df).groupBy("mismatch", "split").count().collect()}
    for label in (0, 1):
        n = sum(1 for _, y in rows if y == label)
        assert counts[label, "train"] == n * 70 // 100
        assert counts[label, "train"] + counts[label, "val"] == n * 85 // 100
    assert counts[2, "test"] == 1
    again = features.stratified_split(df.repartition(3)).exceptAll(features.stratified_split(df))
    assert again.count() == 0
    seeded = features.stratified_split(df, seed=1).exceptAll(features.stratified_split(df))
    assert seeded.count() > 0
    copies = features.oversample(df.where("mismatch < 2"))
    assert {r["count"] for r in copies.groupBy("mismatch").count().collect()} == {sum(1 for _, y in rows if y == 0)}
    per_ticket = [r["count"] for r in copies.where("mismatch = 1").groupBy("ticket_id").count().collect()]
    assert max(per_ticket) - min(per_ticket) <= 1


def test_metrics_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.random() < 0.3, round(rng.random(), 3)) for _ in range(400)]
    df = spark.createDataFrame([(int(y), p) for y, p in rows], "label int, p double")

    def macro(t):
        cells = {(i, j): sum(1 for y, p in rows if int(y) == i and int(p >= t) == j) for i in (0, 1) for j in (0, 1)}
        f = [2 * cells[c, c] / max(2 * cells[c, c] + cells[0, 1] + cells[1, 0], 1) for c in (0, 1)]
        return sum(f) / 2

    got = {r.threshold: r for r in evaluation.threshold_sweep(df, "label", "p").collect()}
    assert len(got) == 20
    assert all(r.macro_f1 == pytest.approx(macro(t)) for t, r in got.items())
    best = max(got, key=lambda t: (got[t].macro_f1, -t))
    assert [t for t, r in got.items() if r.is_best] == [best]
    m = evaluation.classification_metrics(df.selectExpr("label true_label", "cast(p >= 0.5 as int) predicted_label")).first()
    assert m.macro_f1 == pytest.approx(macro(0.5)) and m.support_0 + m.support_1 == 400


def test_metrics_without_division_errors(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "true_label int, predicted_label int")
    m = evaluation.classification_metrics(df).first()
    assert (m.accuracy, m.recall_1, m.precision_1, m.macro_f1) == (1.0, 0.0, 0.0, 0.5)


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(tuple(r) for r in features.standardize(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([("1", "red red blue"), ("2", "red green"), ("3", "")], "ticket_id string, text string")
    model = TfidfModel.fit(df, "text", 10, bigrams=False, min_df=1)
    assert model.terms == ["blue", "green", "red"]
    idf = {t: math.log(4 / (1 + d)) + 1 for t, d in (("blue", 1), ("green", 1), ("red", 2))}
    assert model.idf == pytest.approx([idf[t] for t in model.terms])
    got = {(r.ticket_id, r.term): r.weight for r in model.term_rows(df, "ticket_id", "text").collect()}
    red, blue = (1 + math.log(2)) * idf["red"], idf["blue"]
    norm = math.hypot(red, blue)
    assert got["1", "red"] == pytest.approx(red / norm) and got["1", "blue"] == pytest.approx(blue / norm)
    assert not [k for k in got if k[0] == "3"]
    vectors = {r.ticket_id: r.v for r in model.vectors(df, "text", "v").collect()}
    assert vectors["1"].size == 3 and vectors["3"].numNonzeros() == 0
    assert vectors["1"][2] == pytest.approx(red / norm)


def test_latent_vectors_against_exact_svd(spark):
    rng = np.random.default_rng(5)
    matrix = (rng.random((300, 40)) < 0.15) * rng.random((300, 40)) * np.linspace(3, 0.2, 40)
    rows = [([int(j) for j in np.flatnonzero(row)], [float(v) for v in row[row != 0]]) for row in matrix]
    df = spark.createDataFrame(rows, "indices array<int>, weights array<double>").repartition(3)
    model = fit_latent(df, 40, k=10, passes=8)
    exact = np.linalg.svd(matrix)
    assert model.singular_values == pytest.approx(exact[1][:10], rel=1e-6)
    overlap = np.linalg.svd(model.components.T @ exact[2][:10].T)[1]
    assert overlap.min() > 0.95
    projected = np.array([r.v for r in df.select(model.vectors(F.col("indices"), F.col("weights")).alias("v")).collect()])
    norms = np.linalg.norm(projected, axis=1)
    assert np.all((abs(norms - 1) < 1e-9) | (norms == 0))


def test_latent_vectors_reach_their_residual(spark, monkeypatch):
    """Close singular values in 120 dimensions, a random start of 15 columns."""
    rng = np.random.default_rng(6)
    matrix = rng.random((400, 120)) * (rng.random((400, 120)) < 0.2)
    rows = [([int(j) for j in np.flatnonzero(row)], [float(v) for v in row[row != 0]]) for row in matrix]
    df = spark.createDataFrame(rows, "indices array<int>, weights array<double>").repartition(2)
    passes = []
    step = latent._gram_product
    monkeypatch.setattr(latent, "_gram_product", lambda *a: passes.append(1) or step(*a))
    exact = np.linalg.svd(matrix)[1][:5]
    model = fit_latent(df, 120, k=5, passes=20, residual=1e-6)
    assert model.singular_values == pytest.approx(exact, rel=1e-6) and len(passes) < 20
    gram = matrix.T @ matrix
    errors = np.linalg.norm(gram @ model.components - model.components * model.singular_values**2, axis=0)
    assert errors.max() <= 1.01e-6 * exact[0] ** 2
    few = len(passes)
    fit_latent(df, 120, k=5, passes=20, residual=1e-1)
    assert len(passes) - few < few


def test_latent_rank_is_capped(spark):
    df = spark.createDataFrame([([0, 1], [1.0, 1.0]), ([2], [2.0]), ([0, 1], [2.0, 2.0])], "indices array<int>, weights array<double>")
    assert len(fit_latent(df, 5, k=4).singular_values) == 2


def test_resolver():
    columns = ["Ticket_Subject", "Ticket_Description", "Priority_Level", "Ticket_Channel", "Issue_Category",
               "Resolution_Time_Hours", "Ticket ID"]
    found = resolve_columns(columns)
    assert found == {
        "subject": "Ticket_Subject", "description": "Ticket_Description", "priority_raw": "Priority_Level",
        "channel": "Ticket_Channel", "category": "Issue_Category", "resolution_raw": "Resolution_Time_Hours",
        "ticket_id": "Ticket ID"}
    assert resolve_columns(["subject", "description", "assigned"], "batch")["priority_raw"] == "assigned"
    assert resolve_columns(["Description", "level"])["priority_raw"] == "level"
    assert find_column(["a_Resolution_x_TIME"], "resolution", "time") == "a_Resolution_x_TIME"
    with pytest.raises(ValueError, match="subject"):
        resolve_columns(["description", "priority"], "batch")


def test_absent_optional_columns_are_null(spark):
    df = spark.createDataFrame([("d", "High")], "description string, priority string")
    row = to_tickets(df).first()
    assert row.description == "d" and row.channel is None and row.ticket_id is None


def test_labels_are_the_scale():
    assert LABELS == ("Low", "Medium", "High", "Critical")


def test_shares_of_empty_and_one_class_tables(spark):
    none = spark.createDataFrame([], "label int, mismatch int, level string")
    from prioscope.operators import evaluation as ev, profiling as pr

    assert pr.class_balance(none).first()["mismatch_percent"] is None
    assert {r["percent"] for r in pr.label_distribution(none, "level").collect()} == {None}
    one = spark.createDataFrame([(1,)], "label int")
    assert {r["label"]: r["weight"] for r in ev.class_weights(one, "label").collect()} == {0: None, 1: 0.5}
