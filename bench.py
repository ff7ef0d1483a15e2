"""Benchmark the headline queries.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with Spark ``local[$BENCH_CPUS]``: the marketplace tables are materialised once
(timed as ``prepare``), then every query gets one warm-up and three timed runs
into the ``noop`` sink; the median is reported.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from escrowlens import registry  # noqa: E402
from escrowlens.session import build_session  # noqa: E402
from escrowlens.sources.marketplace import marketplace_paths  # noqa: E402

HEADLINE = ["admin_stats_v2", "admin_orders_v2", "buyer_dashboard", "seller_dashboard_asis",
            "catalog_search", "home_recommended", "settle_commission", "escrow_running",
            "adjust_wallets", "inbox", "quality_violations", "stream_dedup"]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)),
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "4g")})
    t0 = time.time()
    marketplace_paths(spark, sf_dir)
    prepare = time.time() - t0
    qs = registry.queries()
    out = {}
    for name in names:
        q = qs[name]
        _run(q(spark, sf_dir))  # warm-up
        times = []
        for _ in range(runs):
            t = time.time()
            _run(q(spark, sf_dir))
            times.append(time.time() - t)
        out[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "prepare_sec": round(prepare, 3),
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
