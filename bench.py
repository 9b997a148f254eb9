"""Benchmark the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERIES`` (comma list, default the headline set),
``BENCH_WARMUP_DIR`` (default /root/testdata/sf0.001, empty to skip).

The JVM is warmed first by running the same queries once on the smallest
scale factor (class loading and code generation are a fixed cost unrelated to
data size).  Then each query is planned and fully executed ``BENCH_RUNS``
times (default 2) at ``BENCH_SF_DIR`` through the ``noop`` sink (no rows are
collected to the driver) and the best wall time is reported; it covers
planning, lineage cuts and execution.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotwise.plans.registry import QUERIES, load_all  # noqa: E402
from slotwise.session import get_session  # noqa: E402

HEADLINE = [
    "hourly_demand",
    "demand_panel",
    "feature_table",
    "feature_profile",
    "quality_audit",
    "null_audit",
    "describe_trips",
    "weekday_hour_matrix",
    "correlation_ranking",
    "lookup_table",
    "forecast_table",
    "top_zones",
    "predict_validation",
    "naive_forecast_metrics",
    "naive_cv_summary",
    "random_split",
    "time_series_folds",
    "linear_model_metrics",
    "streaming_hourly_demand",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    load_all()
    spark = get_session(
        f"local[{cpus}]",
        app_name="slotwise-bench",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
        conf={
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    def execute(name: str, where: str) -> None:
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()

    failed: dict[str, str] = {}
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm_dir:
        for name in names:
            try:
                execute(name, warm_dir)
            except Exception as exc:  # noqa: BLE001 - reported, bench goes on
                failed[name] = f"warm-up: {type(exc).__name__}"

    runs = max(int(os.environ.get("BENCH_RUNS", "2")), 1)
    times: dict[str, float] = {}
    for name in names:
        best = float("inf")
        try:
            for _ in range(runs):
                t0 = time.perf_counter()
                execute(name, sf_dir)
                best = min(best, time.perf_counter() - t0)
            times[name] = round(best, 3)
        except Exception as exc:  # noqa: BLE001 - reported, bench goes on
            failed[name] = type(exc).__name__
    # single-process pandas statement of the feature build on the same data,
    pandas_sec = None
    if os.environ.get("BENCH_PANDAS", "1") == "1":
        try:
            import importlib.util

            import pandas as pd

            path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "scripts", "pandas_baseline.py")
            spec = importlib.util.spec_from_file_location("pandas_baseline", path)
            mod = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(mod)
            t0 = time.perf_counter()
            mod.build(pd.read_parquet(f"{sf_dir}/events.parquet"))
            pandas_sec = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001 - comparison only
            failed["pandas_feature_build"] = type(exc).__name__
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "runs": runs,
                "timing": "best of runs per query, after a warm-up pass",
                "failed": failed,
                "pandas_single_process_feature_build_sec": pandas_sec,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
