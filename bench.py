"""Headline queries at one scale; prints one JSON line (median of three warm runs, seconds)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from radiolens.catalog import CHECKS, Tables  # noqa: E402
from radiolens.plans.stage import release  # noqa: E402
from radiolens.session import local_session  # noqa: E402

HEADLINE = (
    "clean_umts", "umts_features", "umts_features_notebook", "asof_nearest", "asof_nearest_keyless",
    "coverage_features", "coverage_features_keyless", "rolling_mean_cell", "rolling_mean_cell_chunked",
    "cell_recommendations", "describe_all", "correlation_matrix", "box_stats", "kde", "roc_auc", "pr_auc",
    "compare_models", "rscp_drop", "duration_alarms", "ping_pong", "stratified_split", "impute_median",
    "chunk_words", "cosine_topk", "build_prompts",
)
RUNS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "radiolens-bench")
    spent = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            CHECKS[name].run(Tables(spark, sf)).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            release(spark)
        spent[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(x, 2) for x in times], file=sys.stderr, flush=True)
    total = round(sum(spent.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": spent, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
