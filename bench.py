"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and run twice into Spark's no-op sink, which computes every
row and column without collecting them; the faster run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from burnledger.plans.registry import QUERIES  # noqa: E402
from burnledger.session import local_session  # noqa: E402

HEADLINES = (
    "shared_usage", "shared_balance", "publish_all", "published_balance", "rate_sheet", "priced_usage",
    "cumulative_spend", "balances", "portfolio_kpis", "customer_summary", "deep_dive", "monthly_by_customer",
    "service_daily", "top5_trend", "margin_report", "overview", "usage_vs_entitlement", "breakout_3m",
    "consumption_mix", "reconcile", "config_gaps",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, name="bench")
    QUERIES["shared_usage"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    seconds = {}
    for name in HEADLINES:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
