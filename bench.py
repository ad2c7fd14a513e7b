"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully executed with the ``noop`` sink (no collect to the
driver) three times: the first run pays codegen and JIT for its plan
shape (``cold``); ``queries`` reports the best of the two warm runs.
``value`` is the sum of the warm times.  Queries that checkpoint (the
sweep) write their shared table again on every run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "total_activity",      # minimum slice: clean -> move -> window sums
    "motion_clean",        # z mask + cage mask + gap fill + rolling sums
    "ingest_frames",       # log text -> long positions
    "contact_bouts",       # pair distances, events, bouts, 2 thresholds
    "bin_interaction",     # zero-filled bins with running totals
    "sweep_long",          # every family x window x bin x threshold
    "compare_sweep",       # all t tests of the sweep, both designs
)


def main() -> None:
    from cagetrace.plans.registry import QUERIES
    from cagetrace.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(HEADLINE)
    scratch = tempfile.mkdtemp(prefix="cagetrace-bench-")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus * 2, scratch=scratch)
    times, cold = {}, {}
    for name in names:
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        cold[name], times[name] = runs[0], min(runs[1:])
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "cold": cold,
                      "cold_total": round(sum(cold.values()), 3), "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
