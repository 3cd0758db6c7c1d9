"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a comma-separated
choice. Each query runs in full into Spark's no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ruleflow.queries import QUERIES  # noqa: E402
from ruleflow.storage import local_session  # noqa: E402

HEADLINE = [
    "c7_cleaned_frame", "c8_raw_frame", "c5_seeded_shuffle", "c6_balanced_sample",
    "d1_moderation_prompt", "d3_pair_text", "d8_chat_text", "d8_chat_turns",
    "e2_left_truncation", "e3_left_padding", "e4_right_padding", "e5_length_batches",
    "f1_word_ngrams", "f2_char_ngrams", "f3_vocabulary", "f4_tfidf", "f5_feature_union",
    "g1_stratified_folds", "g6_roc_auc", "g3_logistic_regression", "g4_sigmoid_calibration", "g5_out_of_fold", "g7_final_scores",
    "h1_verdict_probability", "h4_batch_scoring", "h5_rank_within_rule", "h5_rank_by_ranges",
    "h6_weighted_blend", "h9_submission_checks", "h10_restore_order",
    "i5_frame_summary", "j3_rank_blend", "h_ensemble_submission",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("ruleflow-bench", cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # One query before the clock, so that the first one does not pay for starting up.
    QUERIES["d3_pair_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))


if __name__ == "__main__":
    main()
