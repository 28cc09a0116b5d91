"""Every query by name: a function of (spark, data folder) that returns a DataFrame.

Queries run over whole tables. Where an operator consumes a learned value
(cluster, predicted minutes, probability), the query feeds it a column derived
from the ticket number, so that results can be checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicons as lx
from ..functions.durations import hours_to_minutes, parse_minutes
from ..functions.evidence import STYLES, tier_message
from ..functions.rounding import round_exact
from ..functions.severity import mismatch_type, severity_from_probability, severity_number
from ..operators import (
    cleaning, clustering, dashboards, dossiers, evaluation, features, filling, fusion, heavy, learned, profiling, signals,
    terms,
)
from ..operators.classifier import Training, train_classifier
from ..sources.composed import CHANNEL_NAMES, composed_tickets, read_table, spread
from ..sources.resolver import to_tickets
from ..sources.tables import written
from . import audit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EXTRA = ["ticket_num"]
VOCABULARY = 5000
MODEL_THRESHOLD = 0.64


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# --- shared inputs ----------------------------------------------------------

def raw(spark: SparkSession, d: str) -> DataFrame:
    """Canonical columns before cleaning, resolution times as text."""
    return to_tickets(composed_tickets(spark, d).drop("resolution_time_hours"), keep=EXTRA)


def clean(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_tickets(raw(spark, d))


def matched(spark: SparkSession, d: str) -> DataFrame:
    return signals.with_phrase_hits(clean(spark, d))


def with_minutes(df: DataFrame) -> DataFrame:
    """Missing resolution times become 60."""
    return df.withColumn("resolution_minutes", F.coalesce("resolution_minutes", F.lit(filling.DEFAULT_MINUTES)))


def with_cluster(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster_id", (F.col("ticket_num") % 4).cast("int"))


def with_probability(df: DataFrame) -> DataFrame:
    return df.withColumn("prob_mismatch", ((F.col("ticket_num") * 37) % 100) / F.lit(100.0))


def with_cluster_severity(df: DataFrame) -> DataFrame:
    """Median-filled minutes and the severity of the stand-in cluster."""
    filled = with_cluster(filling.median_filled(df, "resolution_minutes", "predicted_minutes"))
    return clustering.attach_cluster_severity(filled, clustering.rank_clusters(filled, "time", "predicted_minutes"))


TEXT_COLUMNS = ("subject", "description", "priority_raw", "resolution_raw")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Stage table: signals 1 and 4 of every ticket, without the texts."""
    return written(signals.density_signal(signals.tier_signal(matched(spark, d))).drop(*TEXT_COLUMNS), "scored")


def light_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Signal 1 fused with the stand-in cluster, and the mismatch label."""
    return fusion.label_mismatch(fusion.fuse(with_cluster_severity(scored(spark, d))))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """All four signals, the fused severity and the mismatch label."""
    return fusion.label_mismatch(fusion.fuse(signals.quartile_bucket(with_cluster_severity(scored(spark, d)))))


def predicted(df: DataFrame) -> DataFrame:
    """Stand-in probability, prediction and the severity and type they imply."""
    out = with_probability(df).withColumn("predicted_label", (F.col("prob_mismatch") >= 0.5).cast("int"))
    out = out.withColumn("inferred_severity", severity_from_probability(
        F.col("predicted_label"), F.col("prob_mismatch"), F.col("assigned_priority")))
    return out


def audited(spark: SparkSession, d: str) -> DataFrame:
    return predicted(matched(spark, d))


# --- flagship ---------------------------------------------------------------

@query
def mismatch_by_channel(spark: SparkSession, d: str) -> DataFrame:
    """Tickets and mismatches between signal 1 and the assigned priority, per channel."""
    tiered = signals.tier_signal(matched(spark, d))
    gap = F.col("llm_severity_num") - F.col("assigned_num")
    return tiered.groupBy("channel").agg(
        F.count("*").alias("tickets"),
        F.count_if(F.abs(gap) >= 2).alias("mismatches"),
        F.count_if(gap >= 2).alias("under_prioritised"),
        round_exact(F.avg((F.abs(gap) >= 2).cast("int")) * 100, 1).alias("mismatch_percent"),
    )


# --- cleaning ---------------------------------------------------------------

@query
def clean_tickets(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d).select(
        "ticket_id", "subject", "description", "priority_raw", "assigned_priority", "assigned_num", "channel",
        "category", "resolution_raw", F.round("resolution_minutes", 6).alias("resolution_minutes"))


@query
def dropped_rows(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.dropped_rows(raw(spark, d))


@query
def parse_resolution_time(spark: SparkSession, d: str) -> DataFrame:
    minutes = parse_minutes(F.col("resolution_raw"))
    return raw(spark, d).select("ticket_id", F.round(minutes, 6).alias("resolution_minutes"))


@query
def hours_to_minutes_(spark: SparkSession, d: str) -> DataFrame:
    minutes = hours_to_minutes(F.col("resolution_time_hours"))
    return composed_tickets(spark, d).select("ticket_id", F.round(minutes, 6).alias("resolution_minutes"))


def _filled(df: DataFrame) -> DataFrame:
    return df.select("ticket_id", F.round("filled", 6).alias("filled"))


@query
def fill_median(spark: SparkSession, d: str) -> DataFrame:
    return _filled(filling.fill_median(raw(spark, d), "resolution_raw", "filled"))


@query
def fill_first_token(spark: SparkSession, d: str) -> DataFrame:
    return _filled(filling.fill_first_token_when_sparse(raw(spark, d), "resolution_raw", "filled"))


@query
def fill_first_token_when_empty(spark: SparkSession, d: str) -> DataFrame:
    """On times given only as text with a unit, so that no value is a number."""
    tickets = raw(spark, d).withColumn("resolution_text", F.concat("resolution_raw", F.lit(" min")))
    return _filled(filling.fill_first_token_when_empty(tickets, "resolution_text", "filled"))


@query
def fill_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _filled(raw(spark, d).withColumn("filled", filling.fixed_fill(F.col("resolution_raw"))))


@query
def ticket_keys(spark: SparkSession, d: str) -> DataFrame:
    """Ids of tickets that lost theirs, by position."""
    lost = raw(spark, d).withColumn("given_id", F.when(F.col("priority_raw").isNotNull(), F.col("ticket_id")))
    return cleaning.with_ticket_id(lost.drop("ticket_id"), ["given_id"], "ticket_num").select(
        "ticket_num", "ticket_id", "row_index")


@query
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    """Ids from content, for a table without ids."""
    content = ["subject", "description", "priority_raw", "channel", "resolution_raw"]
    return cleaning.with_content_id(raw(spark, d).drop("ticket_id"), content).select("ticket_num", "ticket_id")


@query
def model_input_text(spark: SparkSession, d: str) -> DataFrame:
    minutes = filling.fixed_fill(F.col("resolution_raw"))
    channel = cleaning.channel_or_default(F.col("channel"), cleaning.DEFAULT_CHANNEL)
    text = cleaning.model_input_text(F.col("subject"), F.col("description"), channel, minutes)
    return raw(spark, d).select("ticket_id", text.alias("input_text"))


# --- profiling --------------------------------------------------------------

@query
def profile_shape(spark: SparkSession, d: str) -> DataFrame:
    return profiling.table_shape(composed_tickets(spark, d))


@query
def profile_head(spark: SparkSession, d: str) -> DataFrame:
    """The first five tickets: a report of five rows."""
    return profiling.head(raw(spark, d), "ticket_num", 5)


@query
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return profiling.column_info(raw(spark, d))


@query
def profile_missing(spark: SparkSession, d: str) -> DataFrame:
    return profiling.missing_values(raw(spark, d))


@query
def priority_frequency(spark: SparkSession, d: str) -> DataFrame:
    return profiling.frequency(raw(spark, d), "priority_raw", "priority")


@query
def describe_resolution(spark: SparkSession, d: str) -> DataFrame:
    return profiling.describe(clean(spark, d), "resolution_minutes")


@query
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profiling.label_distribution(signals.tier_signal(matched(spark, d)), "llm_severity_score")


@query
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return profiling.class_balance(light_labelled(spark, d))


# --- signals ----------------------------------------------------------------

@query
def tiered_severity(spark: SparkSession, d: str) -> DataFrame:
    return signals.tier_signal(matched(spark, d)).select("ticket_id", "llm_severity_score", "llm_severity_num")


@query
def tiered_severity_short(spark: SparkSession, d: str) -> DataFrame:
    return signals.tier_signal(matched(spark, d), short_tiers=True).select("ticket_id", "llm_severity_score")


@query
def keyword_density_weighted(spark: SparkSession, d: str) -> DataFrame:
    out = signals.density_signal(matched(spark, d), lx.ESCALATION_15, lx.NEGATIONS_9)
    return out.select("ticket_id", "words", F.round("raw_density", 8).alias("raw_density"), "keyword_density")


@query
def keyword_density_double_hits(spark: SparkSession, d: str) -> DataFrame:
    return signals.double_hit_density(matched(spark, d)).select(
        "ticket_id", "escalation_hits", "negation_hits", "keyword_density", "rule_nlp_severity")


@query
def density_severity(spark: SparkSession, d: str) -> DataFrame:
    return signals.density_signal(matched(spark, d)).select("ticket_id", "keyword_density", "rule_nlp_severity")


@query
def top_keyword(spark: SparkSession, d: str) -> DataFrame:
    return signals.top_keyword(matched(spark, d)).select("ticket_id", "top_keyword", "keyword_weight")


@query
def document_density(spark: SparkSession, d: str) -> DataFrame:
    """Keyword density of long multilingual texts, read whole."""
    texts = spread(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.lit("").alias("subject"), F.col("text").alias("description"))
    # A stage table: each text is searched once, whatever reads its hits.
    hits = written(signals.with_phrase_hits(texts).select("doc_id", "hits", "words"), "document-hits")
    dense = signals.density_signal(hits)
    return dense.select("doc_id", F.size("hits").alias("phrase_hits"), "words", "keyword_density", "rule_nlp_severity")


@query
def resolution_tier_quartile(spark: SparkSession, d: str) -> DataFrame:
    tiers = signals.tier_by_quartiles(clean(spark, d))
    cuts = tuple(F.col(c) for c in ("p25", "p50", "p75"))
    message = tier_message(STYLES["full"], F.col("resolution_tier"), F.col("resolution_minutes"), cuts)
    return tiers.select("ticket_id", "resolution_tier", message.alias("message"))


@query
def resolution_tier_fixed(spark: SparkSession, d: str) -> DataFrame:
    return signals.tier_by_fixed_cuts(clean(spark, d)).select("ticket_id", "resolution_tier")


@query
def quartile_bucket(spark: SparkSession, d: str) -> DataFrame:
    filled = filling.median_filled(clean(spark, d), "resolution_minutes", "predicted_minutes")
    return signals.quartile_bucket(filled).select("ticket_id", "regression_severity")


# --- fusion and labels ------------------------------------------------------

@query
def fuse_ceil_mean(spark: SparkSession, d: str) -> DataFrame:
    """Signal 1, joined by ticket id as a table of its own, fused with the clusters."""
    tickets = matched(spark, d)
    signal = signals.tier_signal(tickets).select("ticket_id", "llm_severity_score")
    joined = fusion.attach_signal(tickets, signal, "llm_severity_score")
    return fusion.fuse(with_cluster_severity(joined)).select(
        "ticket_id", "llm_severity_score", "cluster_severity", "fused_num", "fused_severity")


@query
def fuse_majority(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(labelled(spark, d), "majority_vote", evaluation.SIGNAL_COLUMNS).select(
        "ticket_id", "fused_num", "fused_severity")


@query
def mismatch_label(spark: SparkSession, d: str) -> DataFrame:
    return light_labelled(spark, d).select("ticket_id", "assigned_num", "fused_num", "severity_delta", "mismatch")


@query
def cluster_rank_by_time(spark: SparkSession, d: str) -> DataFrame:
    filled = with_cluster(filling.median_filled(clean(spark, d), "resolution_minutes", "minutes"))
    return clustering.rank_clusters(filled, "time", "minutes").select(
        "cluster_id", F.round("mean_minutes", 6).alias("mean_minutes"), "tickets", "cluster_severity")


@query
def cluster_rank_by_size(spark: SparkSession, d: str) -> DataFrame:
    return clustering.rank_clusters(with_cluster(clean(spark, d)), "size").select(
        "cluster_id", "tickets", "cluster_severity")


@query
def signal_agreement(spark: SparkSession, d: str) -> DataFrame:
    table = light_labelled(spark, d)
    parts = [evaluation.agreement(table, "llm_severity_score", other).select(
        F.lit(other).alias("compared_with"), "agreement") for other in ("cluster_severity", "assigned_priority")]
    return parts[0].unionByName(parts[1])


@query
def signal_ablation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ablation(labelled(spark, d))


# --- probabilities, rules, hybrid -------------------------------------------

@query
def severity_from_prob(spark: SparkSession, d: str) -> DataFrame:
    judged = predicted(signals.double_hit_density(matched(spark, d)))
    batch = severity_from_probability(F.col("predicted_label"), F.col("prob_mismatch"), F.col("rule_nlp_severity"))
    interactive = severity_from_probability(
        F.col("predicted_label"), F.col("prob_mismatch"), F.col("assigned_priority"), interactive=True)
    return judged.select("ticket_id", batch.alias("batch_severity"), interactive.alias("interactive_severity"))


@query
def mismatch_type_(spark: SparkSession, d: str) -> DataFrame:
    judged = audited(spark, d).withColumn("delta", severity_number(F.col("inferred_severity")) - F.col("assigned_num"))
    kinds = [mismatch_type(F.col("predicted_label"), F.col("delta"), p) for p in (F.col("prob_mismatch"), None)]
    return judged.select("ticket_id", "delta", kinds[0].alias("mismatch_type"), kinds[1].alias("interactive_type"))


def _ruled(spark: SparkSession, d: str, interactive: bool) -> DataFrame:
    return evaluation.with_rule_override(with_minutes(matched(spark, d)), interactive=interactive)


@query
def rule_override(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(spark, d, False).select(
        "ticket_id", "critical_hits", "trivial_hits", "rule_name", F.round("rule_prob", 8).alias("rule_prob"))


@query
def rule_override_interactive(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(spark, d, True).select(
        "ticket_id", "critical_hits", "trivial_hits", "rule_name", F.round("rule_prob", 8).alias("rule_prob"))


def _hybrid(spark: SparkSession, d: str, mode: str) -> DataFrame:
    ruled = with_probability(_ruled(spark, d, mode == "interactive"))
    out = evaluation.with_hybrid(ruled, mode, F.lit(MODEL_THRESHOLD))
    return out.select("ticket_id", "final_pred", F.round("final_prob", 8).alias("final_prob"), "source")


@query
def hybrid_adversarial(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, "evaluation")


@query
def hybrid_app(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, "interactive")


@query
def hybrid_notebook(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, "stronger")


@query
def keyword_baseline(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.keyword_baseline(matched(spark, d)).select("ticket_id", "escalation_phrases", "keyword_pred")


@query
def adversarial_eval(spark: SparkSession, d: str) -> DataFrame:
    """Rules alone against the keyword baseline, expecting the fused mismatch label."""
    table = with_minutes(light_labelled(spark, d))
    ruled = evaluation.keyword_baseline(evaluation.with_rule_override(table))
    judged = ruled.withColumn("final_pred", F.col("rule_prob").isNotNull().cast("int"))
    return evaluation.robustness_score(judged, "mismatch")


# --- dossiers and dashboard -------------------------------------------------

@query
def dossier_flat(spark: SparkSession, d: str) -> DataFrame:
    return dossiers.flat_dossiers(audited(spark, d))


@query
def dossier_flat_batch(spark: SparkSession, d: str) -> DataFrame:
    return dossiers.flat_dossiers(audited(spark, d), "batch")


@query
def dossier_flat_interactive(spark: SparkSession, d: str) -> DataFrame:
    return dossiers.flat_dossiers(audited(spark, d), "interactive")


@query
def dossier_nested(spark: SparkSession, d: str) -> DataFrame:
    return dossiers.dossiers(audited(spark, d))


@query
def dossier_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The nested evidence, one row per signal."""
    return dossiers.dossiers(audited(spark, d)).select("ticket_id", F.inline_outer("feature_evidence"))


@query
def dossier_joined(spark: SparkSession, d: str) -> DataFrame:
    """Predictions without texts, joined to their tickets by id."""
    predictions = audited(spark, d).select("ticket_id", "predicted_label", "prob_mismatch", "channel")
    return dossiers.attach_tickets(predictions, clean(spark, d), ["subject", "description", "channel"]).select(
        "ticket_id", "predicted_label", "prob_mismatch", "channel", "subject", "description", "channel_full")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    judged = audited(spark, d)
    delta = severity_number(F.col("inferred_severity")) - F.col("assigned_num")
    return judged.withColumn("severity_delta", delta.cast("int")).withColumn("mismatch_type", mismatch_type(
        F.col("predicted_label"), F.col("severity_delta"), F.col("prob_mismatch")))


@query
def dossier_summary(spark: SparkSession, d: str) -> DataFrame:
    return dossiers.dossier_summary(_typed(spark, d), F.lit(0.5))


@query
def dossier_examples(spark: SparkSession, d: str) -> DataFrame:
    return dossiers.dossier_examples(dossiers.dossiers(audited(spark, d)))


@query
def batch_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Result table of a batch audit on the stand-in probability."""
    return audit.prediction_columns(_typed(spark, d))


@query
def mismatch_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.mismatch_type_counts(_typed(spark, d))


@query
def overall_counts(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.overall_counts(_typed(spark, d))


@query
def delta_heatmap(spark: SparkSession, d: str) -> DataFrame:
    out = dashboards.delta_heatmap(light_labelled(spark, d), CHANNEL_NAMES)
    return out.select("category", *[F.round(F.col(f"`{c}`"), 6).alias(c.lower().replace(" ", "_"))
                                    for c in (*CHANNEL_NAMES, "Other")])


# --- classifier measures ----------------------------------------------------

def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in predictions against the fused label."""
    return with_probability(light_labelled(spark, d)).select(
        F.col("mismatch").alias("true_label"), "prob_mismatch",
        (F.col("prob_mismatch") >= 0.5).cast("int").alias("predicted_label"))


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion_matrix(_judged(spark, d), "true_label", "predicted_label")


@query
def confusion_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Given labels: quality as truth, toxic as prediction."""
    return evaluation.confusion_matrix(read_table(spark, d, "labels"), "quality", "toxic")


@query
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.classification_metrics(_judged(spark, d)))


@query
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.quality_gates(evaluation.classification_metrics(_judged(spark, d))))


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.threshold_sweep(_judged(spark, d), "true_label", "prob_mismatch"))


@query
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.class_weights(light_labelled(spark, d), "mismatch"))


# --- terms and features -----------------------------------------------------

def texts(spark: SparkSession, d: str) -> DataFrame:
    joined = F.concat("subject", F.lit(" "), F.coalesce("description", F.lit("")))
    return clean(spark, d).select("ticket_id", joined.alias("text"))


@query
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.vocabulary(texts(spark, d), "text", VOCABULARY)


@query
def document_terms(spark: SparkSession, d: str) -> DataFrame:
    """The 3,000 most frequent words and pairs of the long texts: a top-k report."""
    documents = spread(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return terms.vocabulary(documents, "text", 3000)


@query
def frequent_document_terms(spark: SparkSession, d: str) -> DataFrame:
    """The same report from summaries of bounded size and exact counts of the candidates."""
    documents = spread(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return heavy.frequent_terms(documents, "text", 3000)


@query
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    table = texts(spark, d)
    model = terms.TfidfModel.fit(table, "text", VOCABULARY)
    return model.term_rows(table, "ticket_id", "text").select("ticket_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    labels = written(light_labelled(spark, d).select("ticket_id", "mismatch"), "labels")
    return features.stratified_split(labels).select("ticket_id", "mismatch", "split")


@query
def oversample(spark: SparkSession, d: str) -> DataFrame:
    return features.oversample(written(light_labelled(spark, d).select("ticket_id", "mismatch"), "labels"))


@query
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    tickets = clean(spark, d)
    encoder = features.fit_label_encoder(tickets, "channel", "code")
    return encoder.transform(tickets).select("ticket_id", "channel", F.col("code").cast("int").alias("code"))


@query
def text_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(features.text_features(matched(spark, d)).select("ticket_id", *features.TEXT_FEATURES))


@query
def standardize(spark: SparkSession, d: str) -> DataFrame:
    table = features.text_features(matched(spark, d)).select("ticket_id", *features.TEXT_FEATURES)
    return _rounded(features.standardize(table, features.TEXT_FEATURES), 6)


# --- learned operators: rows and invariants only -----------------------------

@query
def lsa_vectors(spark: SparkSession, d: str) -> DataFrame:
    return learned.with_latent_vectors(texts(spark, d))[0].select("ticket_id", "vector")


@query
def cluster_severity(spark: SparkSession, d: str) -> DataFrame:
    return learned.cluster_signal(clean(spark, d)).select(
        "ticket_id", "cluster_id", "cluster_severity")


@query
def regression_severity(spark: SparkSession, d: str) -> DataFrame:
    return learned.regression_signal(clean(spark, d)).select(
        "ticket_id", "predicted_minutes", "regression_severity")


@query
def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means with restarts on given vectors."""
    vectors = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    found = clustering.fit_clusters(vectors, "vector")
    return vectors.select("vec_id", found.nearest(F.col("vector")).alias("cluster_id"))


# Fits of this process, by application and input: four queries read the same one.
_FITTED: dict[tuple, tuple[DataFrame, Training]] = {}


def _training(spark: SparkSession, d: str) -> tuple[DataFrame, Training]:
    """Classifier of the fused label from signal 1 and the stand-in clusters, fitted once per session and input."""
    # Rows and an order-free checksum: other rows in the same folder are another input.
    events = read_table(spark, d, "events")
    marks = events.agg(F.count("*"), F.bit_xor(F.xxhash64(*events.columns))).first()
    key = (spark.sparkContext.applicationId, d, *marks)
    if key not in _FITTED:
        _FITTED[key] = _fitted(spark, d)
    return _FITTED[key]


def _fitted(spark: SparkSession, d: str) -> tuple[DataFrame, Training]:
    table = fusion.label_mismatch(fusion.fuse(with_cluster_severity(
        written(signals.tier_signal(matched(spark, d)), "matched"))))
    table = written(table, "classifier-input")
    return table, train_classifier(table)


@query
def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Test predictions of the trained ensemble."""
    return _training(spark, d)[1].test_predictions


@query
def classifier_quality(spark: SparkSession, d: str) -> DataFrame:
    return _training(spark, d)[1].metrics


@query
def batch_audit(spark: SparkSession, d: str) -> DataFrame:
    """All tickets scored by a freshly trained ensemble and the rules."""
    table, training = _training(spark, d)
    return audit.prediction_columns(audit.batch_audit(table.drop("hits", "words"), training.model), short=True)


@query
def robustness_eval(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid of ensemble and rules against the fused label, next to the keyword baseline."""
    table, training = _training(spark, d)
    return audit.robustness_run(table.drop("hits", "words").withColumn("expected_mismatch", F.col("mismatch")),
                                training.model)[1]
