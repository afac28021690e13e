"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from anchorage.plans import QUERIES
from anchorage.session import build_session

HEADLINES = (
    "level_metrics",
    "level_metrics_all",
    "last_spell",
    "window_aligned_counts",
    "integrate_sources",
    "join_permanence",
    "population_pyramid",
    "cluster_composition",
    "risk_distribution",
    "vulnerability_matrix",
    "lift_table",
    "auc",
    "rank_deciles",
    "kaplan_meier",
    "hazard_by_month",
    "c_index",
    "contrib_metrics",
    "roi_top_n",
    "profit_curve_threshold",
    "intervention_scenarios",
    "impact_kpis",
    "profit_curve_n",
    "logit_churn",
    "cox_ph",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", partitions=int(cpus), memory="16g")
    for warm in ("level_metrics", "brier"):
        QUERIES[warm](spark, folder).write.format("noop").mode("overwrite").save()
    spent = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    total = round(sum(spent.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, wall clock", "value": total, "unit": "sec", "queries": spent, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
