"""Wall time of the headline queries: one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores. Each query is computed
once in full after a short warm-up. ``BENCH_QUERIES`` (comma-separated) picks others.
"""

from __future__ import annotations

import json
import os
import time

from granary.plans import registry
from granary.plans.catalogue import QUERIES
from granary.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = [
    "d1_monthly_mean_price", "d2_monthly_median_price", "d8_split_correlation", "d9_strongest_lag", "d13_country_extent",
    "d15_describe", "d18_first_values", "d26_two_sample_t", "c2_admin2_join", "c5_cell_outer_join", "c8_enrich_locations",
    "c9_nearest_fill", "c14_bilinear_regrid", "e1_lag_rows", "e4_changes", "e6_interpolate", "e8_accumulate", "h1_index",
    "h2_pooled_impact", "h3_national_impact", "h4_every_scale", "h6_residual_diagnostics", "h8_stationarity",
    "h9_forecast_errors", "h11_feature_subsets", "h20_standardised_by_date",
]


def timed_in(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    registry.run(name, spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def timed(spark, name: str) -> float:
    return timed_in(spark, name, FOLDER)


def main() -> None:
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(CPUS, max(CPUS, 8))
    for warm in ("d12_unit_counts", "h20_standardised_by_date"):
        timed(spark, warm)
    times = {n: timed(spark, n) for n in names if n in QUERIES}
    sf = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
