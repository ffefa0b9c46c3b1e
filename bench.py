"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and then fully executed into Spark's no-op sink (no collect),
so the time covers the whole plan.  Prints one JSON line.

Before timing, every query runs once, untimed, over the smallest test tables
(``$BENCH_WARMUP_DIR``, default /root/testdata/sf0.001; set it empty to skip).
Those are different files, so nothing computed there is reused; the pass only
loads classes and JIT-compiles the code paths, so the timed figures are the
steady state of a long-running session rather than JVM start-up charged to
whichever query happens to run first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablecheck.plans import QUERIES  # noqa: E402
from tablecheck.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g"})
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001").rstrip("/")
    names = [n for n in sorted(QUERIES) if not only or n in only]
    if warm_dir and os.path.isdir(warm_dir) and warm_dir != sf_dir:
        for name in names:
            try:
                QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
            except Exception:  # noqa: BLE001  (a failure is reported by the timed pass)
                pass
    else:
        warm_dir = ""
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": cpus,
           "warmup": f"one untimed pass of every query at {warm_dir}" if warm_dir else "none"}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
