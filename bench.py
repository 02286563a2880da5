"""Time the headline queries; prints one line of JSON.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the cores. Names
given as arguments are timed instead of the headline set; ``all`` times every query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tagloom.queries import QUERIES  # noqa: E402
from tagloom.session import build_session  # noqa: E402

HEADLINE = (
    "attribute_workflow", "quarantine_bad", "field_dictionary", "pivot_attributes", "wide_attributes",
    "drop_null_markers", "clean_value", "build_prompt", "label_records", "missing_records",
    "pending_prompts", "geo_backfill", "standardise_host", "tag_entities", "nearest_neighbours",
    "weighted_sample", "split_first_n", "batch_ids", "majority_vote", "classification_report",
    "token_filter", "top_vocabulary", "tfidf", "document_embedding", "few_shot_tag_classifier",
    "evaluate_tag_classifier", "unrecognised_terms", "score_batches", "within_cluster_sse",
    "kmeans", "prompt_workflow", "approximate_neighbours", "naive_bayes", "word_association",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    names = sys.argv[1:] or list(HEADLINE)
    if names == ["all"]:
        names = list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").count()  # start the executors before timing
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
