"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphloom.plans import catalog  # noqa: E402
from graphloom.session import build_session  # noqa: E402

HEADLINE = [
    "d02_task_rollup", "d01_hot_labels", "d06_patch_statistics", "d10_retrieval_quality", "d20_operation_latency", "e05_logic_clusters",
    "e06_merge_ranges", "e07_running_budget", "c04_callee_resolution", "c05_caller_counts", "c08_reexport_chase", "c12_containment_prune",
    "c17_last_assignment", "h01_dependency_neighbourhood", "h07_topological_levels", "h08_module_graph", "h10_root_causes", "i01_search_cascade",
    "i04_term_search", "i11_planned_context", "i18_project_summary", "i20_architecture_map", "j01_code_health", "j09_regressions",
    "a04_change_classification", "a05_replace_by_key", "b27_line_symbols", "b30_markdown_sections", "s01_idempotent_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["d03_daily_trend"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if len(sys.argv) > 1:
            print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
