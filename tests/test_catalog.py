"""Registered queries against DuckDB. VOXRILL_FULL=1 runs all of them."""

import os

import pytest

from tests.oracle import compare, duck
from voxrill.plans.catalog import CHECK_SQL, COVERS, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = [
    "train_stats", "complete_case_stats", "outlier_flags", "zscore_scores", "recording_summary", "ceiling_pick", "formant_substitution",
    "stats_drift", "session_summary", "confidence_distribution", "frame_track_panel", "signal_gate", "gate_messages", "advice_panels",
    "asof_words", "char_groups", "gap_fill", "run_merge", "silence_pairs", "chunk_words", "chunk_merge", "pages", "score_clusters",
    "queue_rank", "rate_limit", "stage_profile", "balanced_sample", "gender_balance", "speaker_holdout", "content_dedupe", "word_tokens",
    "lexicon_filter", "candidate_scores", "threshold_sweep", "aligner_text_phones", "multi_ceiling_text", "import_check", "prior_attempt",
    "preset_match", "event_replay", "stream_task_states", "stream_rate_windows", "stream_queue_waits",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("VOXRILL_FULL") else QUICK)
def test_matches_sql(spark, con, name):
    res = compare(spark, con, name, SF)
    assert res.startswith(("ok", "rows-only")), res


def test_catalogue_is_consistent():
    assert set(QUERIES) == set(CHECK_SQL)
    assert all(COVERS.values())
