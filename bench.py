"""Time the headline queries on one machine and print one line of JSON.

Tables are those of $BENCH_SF_DIR (default sf0.1), cores $BENCH_CPUS (default 8). Each query is run to completion
through a sink that drops the rows, after a short warm-up on the same tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from surveyloom.plans.catalog import QUERIES
from surveyloom.session import local_session

HEADLINES = [
    "flagship_words_by_language",
    "a1_typed_survey_scan",
    "d14_preprocess",
    "c1_rule_filter",
    "f1_numeric_summary",
    "f2_categorical_frequency",
    "f9_segment_stats_lineitem",
    "f12_classification_metrics",
    "g1_pearson",
    "g2_spearman",
    "h4_reliability_report",
    "h6_fit_indices",
    "i3_monitoring_job",
    "j1_stratified_split",
    "k1_word_tfidf",
    "k4_train_task",
    "k17_language_baseline",
    "l1_next_versions",
    "r7_run_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["f11_confusion_matrix"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
