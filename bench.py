"""Headline timings: prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS steer it."""

from __future__ import annotations

import json
import os
import statistics
import time

from quillfold import catalog
from quillfold.session import get_spark

HEADLINE = (
    "build_report",
    "flag_contaminated",
    "near_duplicates",
    "clean_text",
    "tag_register",
    "features",
    "error_table",
    "validate_contract",
    "within_band",
    "cluster_bootstrap",
    "exemplars_mmr",
    "outlinks",
    "classify_page",
    "screen_eligibility",
    "enrich_details",
    "select_top",
    "topic_bank",
    "fold_applications",
    "verify_chain",
    "stream_fold_applications",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_spark("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # a first small query pays for session start-up
    queries["read_turns"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
