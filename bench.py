"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores. The raw inventory table is
stored first, so that the queries are timed and not the joins that make their test data. Each query runs
BENCH_RUNS times (default 3): `queries` has the medians, `first_runs` the first times, code generation included.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import tempfile
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from checks import catalog  # noqa: E402
from shelflight.session import build_session  # noqa: E402

HEADLINE = (
    "cleaned_inventory", "cleaning_audit", "data_profile", "category_summary", "brand_distribution",
    "supplier_contribution", "daily_trend", "executive_kpis", "abc_classes", "engineered_inventory",
    "scored_by_rules", "recommendations", "impact_summary", "risk_crosstab", "correlation_matrix",
)
MORE = ("pareto_running_share", "days_histogram", "published_by_product", "revenue_model_metrics")


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g", spark__checkpoint__dir=f"{folder}/checkpoints",
        spark__sql__warehouse__dir=f"{folder}/warehouse",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.Stages(spark, data_dir).raw.write.parquet(f"{folder}/raw")
    raw, times = spark.read.parquet(f"{folder}/raw"), {}

    def run(name: str) -> float:
        catalog._FITTED.clear()
        start = time.perf_counter()
        catalog.build(name, catalog.Stages(spark, data_dir, raw)).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("category_summary")  # start-up of the JVM and the first compilation is no query's time
    for name in (*HEADLINE, *MORE):
        times[name] = [run(name) for _ in range(runs)]
    medians = {name: round(statistics.median(seconds), 3) for name, seconds in times.items()}
    result = {
        "metric": "headline_queries_total", "value": round(sum(medians[name] for name in HEADLINE), 3), "unit": "sec",
        "queries": medians, "first_runs": {name: seconds[0] for name, seconds in times.items()},
        "first_runs_total": round(sum(times[name][0] for name in HEADLINE), 3),
        "sf": pathlib.Path(data_dir).name.removeprefix("sf"), "cpus": int(cpus), "runs": runs,
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
