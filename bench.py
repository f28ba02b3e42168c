"""Benchmark: run every registered query over $BENCH_SF_DIR and time it.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver).  Prints one JSON line on stdout:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Set BENCH_QUERIES to a comma-separated subset to time only those, and
BENCH_SHUFFLE_PARTITIONS to override the shuffle partition count.  A query
that fails is left out of the total and listed under "failed".
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crawlq.plans.registry import all_queries  # noqa: E402
from crawlq.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    # One shuffle partition per core suits these small tables (AQE coalesces
    # further); a cluster sizes it to its data instead.
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    spark = local_session(cpus, shuffle_partitions=parts, app="crawlq-bench")

    queries = all_queries()
    names = only or sorted(queries)
    # Warm-up: JIT and codegen caches, not timed.
    queries["stats_by_depth"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            df = queries[name].build(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # keep timing the others; report the failure
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"{name}: FAILED {failed[name]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": m.group(1) if m else sf_dir,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
