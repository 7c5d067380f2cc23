"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from emberwake.plans import QUERIES
from emberwake.session import local_session

HEADLINE = ("qc_filter", "dedup_keep_best", "grid_daily_rollup", "eps_pairs_join", "dbscan_combined", "dbscan_speed", "drop_small_renumber", "episodes_a_full", "episode_record_b", "episode_geometry_b", "overlay_rect", "regime_metrics_a", "regime_metrics_b", "describe_by_group", "zonal_stats", "ch_index", "gap_sessions")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("sum(value)").collect()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
