"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aerolake.session import get_session

HEADLINE = (
    "f2_trajectory_error", "f7_depth_metrics", "f11_benchmark_table", "b5_confidence_filter_stats", "b6_depth_edge", "b9_normal_edge",
    "c1_unproject", "c2_project_join", "c4_multiview_confidence", "c9_asof_pose", "c12_nn_join", "f4_cloud_error", "d6_split_tree",
    "d8_temporal_chunks", "e1_fit_sim3", "e7_balance_correspondences", "g1_voxel_first", "g2_voxel_mean", "g4_sample_cap",
    "g7_coverage_fill", "g10_sample_greedy_chain", "g13_plan_batches", "h3_rasterize", "h4_smooth_raster", "s3_rolling_meter",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    from aerolake.plans import catalog

    # one small query starts the JVM and the Python workers before the clock runs
    catalog.QUERIES["e1_fit_sim3"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
