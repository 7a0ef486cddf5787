"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

from pyspark.sql import SparkSession

from verification.queries import QUERIES

HEADLINE = [
    "d1_collapse_replicates",
    "c1_as_of_history",
    "c2_as_of_probe",
    "c3_cross_target_as_of",
    "b1_quarantine_rows",
    "b8_valid_cells",
    "e12_to_e17_daily_features",
    "c5_add_weather",
    "d5_error_summary",
    "d6_segment_errors",
    "d8_classification_metrics",
    "d11_tail_thresholds",
    "d12_profile_measurements",
    "d14_count_volume_check",
    "d18_site_identity_audit",
    "d20_sensitivity_scenarios",
    "d21_cluster_bootstrap",
    "d31_rank_correlation",
    "i9_select_model",
    "i12_evaluate_test",
    "i15_score_with_context",
    "i21_what_if",
    "c8_revisions",
    "i3_forest_regressor",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's compilers and the file reader on something that is not timed.
    QUERIES["g4_distinct"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}

    def report(*_):
        """The one JSON line; also if the run is ended early, with what was timed so far."""
        print(json.dumps({
            "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "complete": len(seconds) == len(wanted),
        }), flush=True)
        if _:
            os._exit(1)

    signal.signal(signal.SIGTERM, report)
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{seconds[name]:8.3f} s {name}", file=sys.stderr, flush=True)
    report()
    spark.stop()


if __name__ == "__main__":
    main()
