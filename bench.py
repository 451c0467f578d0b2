"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from arealens.session import local_session
from arealens.workload import catalog

HEADLINE = [
    "nation_profile",
    "nation_neighbours",
    "customer_neighbours",
    "embedding_neighbours",
    "nearest_supplier",
    "exact_quartiles",
    "exact_quartiles_of_huge_groups",
    "rolling_rates_by_nation",
    "monthly_rate_features",
    "parent_totals_to_children",
    "seasonal_cases_per_area",
    "daily_cases_per_area",
    "spatial_lexicon",
    "polygon_areas",
    "balance_density",
    "weighted_means_by_region",
    "lower_tier_population",
    "upper_tier_deprivation",
    "mobility_table",
    "daily_panel_by_nation",
    "synthetic_control_weights",
    "scenario_effects",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    queries = catalog.queries()
    queries["weighted_means_by_region"](spark, folder).collect()  # start the workers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
