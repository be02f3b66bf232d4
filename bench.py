"""Time the headline queries on one data folder and print one JSON line.

BENCH_SF_DIR names the folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewright.plans import REGISTRY  # noqa: E402
from tidewright.session import local_session  # noqa: E402

HEADLINE = [
    "asof_skill", "asof_keyed", "skill_export", "correlation_ci", "anomaly_all_seasons", "anomaly_weighted", "anomaly_compare",
    "monthly_normalised", "ices_anomaly", "onset_threshold", "onset_pct_max", "onset_per_cell", "cell_coherence", "nearest_cell",
    "nearest_cell_any", "point_in_polygon", "domain_mean", "cell_lookup", "depth_integral", "column_weighted", "column_interp",
    "block_3day", "bilinear_regrid", "par_mixing_layer", "wind_stress", "flux_field", "scaled_anomaly", "nitrogen_budget",
    "biweekly_climatology_band", "taxon_pivot", "presence_only_mean", "stage_counts", "tow_replication", "dedupe_mean_mode",
    "poly_residual", "residual_years", "year_index", "drop_one_r2", "binned_response", "thermal_curve", "quantiles",
]


def run(spark, name: str, folder: str) -> float:
    t0 = time.perf_counter()
    REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t0
    spark.catalog.clearCache()  # stage tables of one query must not help the next
    return took


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "block_3day", folder)  # start the JVM and load the classes
    times = {n: round(run(spark, n, folder), 3) for n in names}
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
