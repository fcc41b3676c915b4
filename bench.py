"""Time every registered query (best of two) and the timings with published bounds; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradloom.catalog import QUERIES  # noqa: E402
from measure import reference_checks  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = [name for name in QUERIES if not only or name in only]
    QUERIES["accuracy_batched"].build(spark, folder).collect()
    times = {}
    for name in names:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name].build(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 4)
    result = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
              "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    if not only:
        result["reference_checks"] = reference_checks(spark, folder, cpus)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
