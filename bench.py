"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of cores, BENCH_QUERIES a comma separated
choice of queries (default: the headline ones; `all` for every registered query). Every query
runs once on the tables BENCH_WARM_DIR names (default: the smallest scale next to BENCH_SF_DIR,
empty for none) before it is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultsift.catalog import QUERIES  # noqa: E402
from faultsift.session import local_session  # noqa: E402

HEADLINE = (
    "prose_words code_words term_table preprocessed_text processed_sources "
    "prior_activity recency_and_frequency collaborative_filter "
    "pair_cosine localize_lexical corpus_tfidf tfidf_cosine dense_cosine length_scores "
    "indirect_scores synthesized_scores localized_files "
    "sampled_wrong_files ranking_samples report_folds "
    "hit_at_k average_precision positive_ranks metrics_table project_results "
    "interaction_matrix linked_uses graph_edges split_settings small_training_set feature_table"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    smallest = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = os.environ.get("BENCH_WARM_DIR", smallest)
    warm = bool(warm_dir) and os.path.isdir(warm_dir)
    seconds: dict[str, float] = {}
    for name in names:
        if warm:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "total_wall_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}
        )
    )


if __name__ == "__main__":
    main()
