"""Wall time of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from driftline.session import local_session  # noqa: E402

HEADLINE = [
    "a01_circular_mean", "a03_circular_median", "a05_ensembles", "a09_reject_outliers", "a13_champion_centre",
    "a23_campaign_summary", "a24_overall_and_cells", "a31_wind_bins", "j01_interpolate_table", "j02_truth_join",
    "j05_neighbour_count", "j11_header_metadata", "m01_fit_drift", "m04_differential_series", "w01_unwrap",
    "w09_visible_windows", "x02_kappa_sigma", "x05_robust_combine", "x14_dark_barycentre", "x26_drizzle", "g04_suite_quality",
    "t01_lucky_frames", "r02_last_seen",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    from driftline.plans import catalog

    spark.range(10).count()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
