"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full with the ``noop`` sink (no collect to the
driver).  Fixture building is part of every query, as it is in the catalog.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gauntlet.plans.catalog import QUERIES  # noqa: E402
from gauntlet.session import get_spark  # noqa: E402

HEADLINE = [
    "job_evaluation_report", "job_mutation_report", "job_generation_report", "failure_dataset",
    "failure_analysis", "extract_code", "classify_kernel_failure", "latency_percentiles", "speedup_stats",
    "retry_outcome", "progress_running", "upper_median_runtime", "mutation_summary", "src_tasks",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus * 2)
    # untimed warm-up (JVM JIT, Python workers, file listing caches); reported separately
    t0 = time.perf_counter()
    for name in ("classify_kernel_failure", "extract_code", "latency_percentiles"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.perf_counter() - t0, 3)
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": cpus, "warmup_sec": warmup, "spark": spark.version,
                      "shuffle_partitions": cpus * 2}))


if __name__ == "__main__":
    main()
