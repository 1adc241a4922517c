"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aeroframe import build_session  # noqa: E402
from aeroframe.plans import workload  # noqa: E402

HEADLINE = ("regression_metrics", "metrics_grouping_sets", "family_summary", "error_criterion", "worst_n", "row_hard_checks", "duplicate_keep_first", "snapshot_compare",
            "nearest_reference", "interpolation_join", "compare_curves", "curve_metrics", "boundary_edges", "wall_edges", "wall_gradients", "wall_forces", "section_catalogue",
            "zone_forward_fill", "sessionise_marker", "tail_window_stats", "stratified_split", "ingest_dataset", "posterior_metrics", "mode_reconstruction", "predict_queries")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("aeroframe-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(int(cpus) * 2 if cpus.isdigit() else 16), "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.files.maxPartitionBytes": "16m", "spark.sql.files.openCostInBytes": "1m"})
    spark.sparkContext.setLogLevel("ERROR")
    workload.QUERIES["metrics_grouping_sets"](spark, sf).write.format("noop").mode("overwrite").save()      # start the JVM and the Python workers
    took: dict[str, float] = {}
    for name in names:
        begun = time.perf_counter()
        workload.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
