"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prioscope.plans import catalog  # noqa: E402
from prioscope.session import local_session  # noqa: E402

# The classifier at its published sizes takes over six minutes at sf0.1: BENCH_QUERIES=classifier_quality times it.
HEADLINE = (
    "mismatch_by_channel", "clean_tickets", "describe_resolution", "profile_missing", "tiered_severity",
    "density_severity", "keyword_density_double_hits", "document_density", "top_keyword", "rule_override", "hybrid_app",
    "fill_median", "resolution_tier_quartile", "quartile_bucket", "mismatch_label", "signal_ablation", "dossier_flat",
    "dossier_nested", "dossier_summary", "delta_heatmap", "threshold_sweep", "term_counts", "document_terms",
    "tfidf_terms", "stratified_split", "oversample", "text_features", "lsa_vectors", "cluster_severity",
    "regression_severity",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cores, "bench")
    # Start-up of the JVM and of code generation is not part of any query.
    catalog.QUERIES["mismatch_by_channel"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
