"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from asset_atlas.driver import registry
from asset_atlas.session import build_session

HEADLINE = [
    "exact_duplicate_report",
    "overview_counts",
    "name_cluster_members",
    "folder_tree",
    "usage_counts",
    "text_search",
    "jaccard_pairs",
    "reference_hits",
    "asset_usages",
    "color_extraction",
    "type_extraction",
    "color_stats",
    "color_clusters",
    "color_drift",
    "type_drift",
    "nearest_tokens",
    "hamming_pairs",
    "phash_clusters",
    "near_bucket",
    "semantic_bucket",
    "match_buckets",
    "catalogue_upsert",
    "plan_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("asset-atlas-bench", cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    registry.QUERIES["asset_totals"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
