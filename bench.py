"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "train_stats", "complete_case_stats", "outlier_flags", "zscore_scores", "recording_summary", "per_vowel", "ceiling_pick",
    "bucket_percentiles", "score_histogram", "candidate_scores", "weight_grid_cv", "holdout_report", "threshold_sweep",
    "session_summary", "confidence_distribution", "asof_words", "char_groups", "gap_fill", "run_merge", "silence_pairs", "pages",
    "rate_limit", "balanced_sample", "content_dedupe", "prior_attempt", "aligner_text_phones", "signal_gate", "stream_rate_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from voxrill.plans import fit_queries
    from voxrill.plans.catalog import QUERIES
    from voxrill.operators.fit import simplex_grid
    from voxrill.session import local_session

    spark = local_session("bench", cores=cpus, partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds: dict[str, float] = {}
    # 5 151 candidates by utterance folds, next to the 66 of the query.
    extra = {"weight_search_g100": lambda s, d: fit_queries.utterance_cv(s, d, simplex_grid(s, 100))}
    for name in [*HEADLINE, *extra]:
        t = time.time()
        # The whole result is produced and dropped, so no query is paid for driver transfer.
        (QUERIES | extra)[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
