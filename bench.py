"""Seconds per headline query, as one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs once to warm up and is then timed from building the plan to
the last row, which is evaluated in full and discarded. ``cold`` holds the
times of the first runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from freshet.queries import QUERIES
from freshet.session import local_session

HEADLINE = (
    # cleaning and classifying readings
    "value_status_histogram", "clean_value", "parse_notation", "reading_times", "labelled_readings", "readings_csv_scan",
    # coverage and filters
    "coverage_summary", "missing_days", "half_open_day", "reading_filter_set", "latest_earliest",
    # merging and table maintenance
    "deduplicated_batch", "upsert_result", "upsert_actions", "upsert_table", "replace_day",
    # catalogues
    "json_envelope_stations", "json_envelope_measures", "json_envelope_areas", "station_children",
    # areas
    "area_ilike_filter", "area_regex_filter", "area_facets", "polygon_area", "area_rank",
    # relations and series
    "parent_child_join", "orphans_anti", "rolling_anomaly", "lag_correlation", "stream_dedup",
)


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("bench", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        cold[name] = round(seconds(QUERIES[name], spark, sf_dir), 3)
        warm[name] = round(seconds(QUERIES[name], spark, sf_dir), 3)
    result = {
        "metric": "total seconds of headline queries, warm",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        "cpus": int(cpus),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
