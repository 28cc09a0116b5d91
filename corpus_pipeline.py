"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prioscope.llm import decontamination, mixing, sharding, simhash, toxicity
from prioscope.llm.common import table
from prioscope.sources.tables import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.fit_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, shingle=3, distance=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark windows cover; documents that consist of nothing else go."""
    marked = decontamination.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.size("spans") > 0
    changed = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("clean_text")).otherwise(F.col("n_chars"))
    left = F.col("n_words") > decontamination.n_hit()
    return marked.where(~hit | left).withColumns(changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in random order, with shard and slot."""
    return sharding.external_shuffle(docs)


STAGES = [
    ("toxicity", reject_toxic), ("simhash_near_dedup", near_duplicates), ("decontamination", decontaminate),
    ("mixing", mix_sources), ("sharding", shard),
]
# Learned scores, balanced draws and random order have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
