"""Time the headline queries: one JSON line on stdout.

Each query runs whole and is written to the noop sink, so every row is computed
and none goes to the driver. One small query runs first, which opens and measures the
inputs; its time is a line of its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tripmesh.plans.catalogue import QUERIES
from tripmesh.session import RECOMMENDED

HEADLINE = (
    "flights_clean",
    "flight_emissions",
    "daily_totals",
    "emissions_timeline",
    "positions",
    "sampled_positions",
    "damages_by_scenario",
    "final_totals",
    "peak_positions",
    "minute_snapshots",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    settings = {
        **RECOMMENDED,
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    start = time.perf_counter()
    QUERIES["choose_date"](spark, folder).collect()
    opening = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "opening_and_measuring_inputs": opening,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
