"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores,
BENCH_QUERIES a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "scan_in_scope_ledger", "usable_payments", "merged_sources", "account_table", "feature_matrix", "account_history",
    "splitting_windows", "splitting_members", "privilege_results", "circular_results", "fan_out_windows",
    "gather_scatter_windows", "graph_edges", "account_degrees", "clustering_coefficients", "cycle_accounts",
    "trade_components", "density_clusters", "roc_auc", "jackknife_errors", "feature_baselines", "isolation_scores",
    "fused_risk",
)


def main() -> None:
    from moneytrail.plans import registry
    from moneytrail.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINES)
    parts = max(int(cores) if cores.isdigit() else 8, 2)
    spark = local_session(cores, shuffle_partitions=parts, memory="16g")
    # Class loading and code generation are paid once per session, not per query.
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().write.format("noop").mode("overwrite").save()
    queries = registry.callables()
    seconds = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
