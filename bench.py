"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the cores. Each query is run
once to warm up and then ``RUNS`` times; the median counts. A run ends when every row has been produced.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from placewise.session import local_session
from verification import catalog

RUNS = 3
HEADLINE = [
    "area_summary", "enrich_zip", "types_top5_city", "plateau_point_lines", "yield_per_point_events", "upsert_lines",
    "insert_new_lines", "mean_quantity_by_price_quantile", "segment_summary_city", "describe_lines",
    "stratified_split_orders", "corr_matrix_lines", "ols_summary_orders", "collect_new_places", "cap_per_region",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", str(os.cpu_count())), app="bench")
    catalog.load_all()
    times = {}
    for name in HEADLINE:
        runs = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total seconds of the headline queries, medians", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
