"""Time the headline queries at one scale factor and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from plenum.plans.registry import QUERIES
from plenum.session import session

HEADLINE = [
    "weekly_trend_gapfill", "parent_stats_union", "filtered_rollup", "percentile_latency", "lateral_latest_child", "asof_prior_appearance",
    "evidence_preference", "path_patterns", "snapshot_diff", "freeze_upsert", "desired_state_compaction", "rule_table_filter",
    "keyword_alerts", "fulltext_match", "content_address_dedup", "vote_matrix_consensus", "integrity_audit", "platform_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and warms the file cache
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
