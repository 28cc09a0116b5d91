"""Scoring tickets as they arrive, and counting mismatches per time window.

Tier signal, density signal, fixed resolution tiers, rule override and dossiers
depend on their own row only, so the batch functions are used as they are.
What needs the whole table (quartiles, medians, lowered label thresholds) is
replaced by its fixed variant; `tiers` keeps quartiles of all rows so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.dossiers import flat_dossiers
from ..operators.evaluation import with_rule_override
from ..operators.filling import DEFAULT_MINUTES
from ..operators.signals import density_signal, tier_by_fixed_cuts, tier_signal, with_phrase_hits
from ..plans.audit import prepare


def ticket_stream(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet",
                  files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream of raw tickets."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def score(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Prepared tickets with signals 1 and 4, tier and rule outcome; batch or stream."""
    return judged(with_phrase_hits(prepare(raw, keep=keep)))


def judged(matched: DataFrame) -> DataFrame:
    """Signals 1 and 4, tier and rule outcome of prepared tickets with phrase hits."""
    tiered = tier_by_fixed_cuts(density_signal(tier_signal(matched)))
    filled = tiered.withColumn("resolution_minutes", F.coalesce("resolution_minutes", F.lit(DEFAULT_MINUTES)))
    ruled = with_rule_override(filled)
    delta = F.col("llm_severity_num") - F.col("assigned_num")
    return ruled.withColumn("severity_delta", delta).withColumn("mismatch", (F.abs(delta) >= 2).cast("int"))


def dossier_stream(scored: DataFrame, style: str = "interactive") -> DataFrame:
    """Flat evidence records of arriving mismatches, by the styles that need no table-wide cuts; batch or stream.

    Takes the rows of `judged`; without a classifier a mismatch of signal 1 counts
    as a prediction, and the share of the scale it spans as its probability.
    """
    if style == "full":
        raise ValueError("full records need the quartiles of a table: see tiers.tier_stream")
    return flat_dossiers(scored.withColumns({
        "predicted_label": F.col("mismatch"), "prob_mismatch": F.least(F.lit(1.0), F.lit(0.5) + F.abs("severity_delta") / 6),
        "inferred_severity": F.col("llm_severity_score")}), style)


def windowed_mismatches(scored: DataFrame, time: str = "submitted_at", window: str = "1 hour",
                        late: str = "2 hours") -> DataFrame:
    """Tickets and mismatches per channel and tumbling window; rows later than `late` are ignored."""
    timed = scored.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    counts = timed.groupBy(F.window("_time", window), "channel").agg(
        F.count("*").alias("tickets"), F.sum("mismatch").alias("mismatches"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                         "channel", "tickets", "mismatches")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived, write Parquet and stop; a restart continues from the checkpoint."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
