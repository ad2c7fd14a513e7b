"""Print Exchange / scan / window counts of registered queries' physical plans.

    python tools/plan_stats.py [sf_dir] [name ...]   (full plan with -v)
"""
from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def stats(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "exchange": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcast": plan.count("BroadcastExchange"),
        "scan": plan.count("FileScan parquet"),
        "window": len(re.findall(r"\bWindow \[", plan)),
        "sort": len(re.findall(r"\bSort \[", plan)),
        "python": plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") + plan.count("FlatMapGroupsInPandas"),
    }, plan


def main():
    from cagetrace.plans.registry import QUERIES
    from cagetrace.session import build_session
    args = [a for a in sys.argv[1:] if a != "-v"]
    verbose = "-v" in sys.argv
    sf = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a] or list(QUERIES)
    spark = build_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # static plan: count every Exchange
    for n in names:
        s, plan = stats(QUERIES[n](spark, sf))
        print(f"{n:28s} {s}")
        if verbose:
            print(plan)


if __name__ == "__main__":
    main()
