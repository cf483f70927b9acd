"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dayspell.queries import QUERIES  # noqa: E402
from dayspell.session import local_session  # noqa: E402

HEADLINE = (
    "qc_station_band", "qc_slot_cube", "station_months", "seasonal_anomaly_stations",
    "seasonal_anomaly_field", "band_anomaly", "record_counts_by_unit", "record_series_network",
    "record_series_grid", "heat_thresholds", "heatwave_counts_stations", "heatwave_idw_series",
    "exceedance_map", "local_days_3h", "paired_months", "lowess", "trend_significance", "master_table",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "dayspell-bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # JVM and reader warm-up
    seconds: dict[str, float] = {}
    first: dict[str, float] = {}
    for turn in (first, seconds):  # the first round compiles; the second one is reported
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            turn[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "first_round": first, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
