"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose tables and cores.
Each query runs once to warm up and then is timed; its rows are written to nowhere, so all columns
are made.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from tideline.plans import catalogue

HEADLINE = [
    "log_scan_after", "log_append", "prefix_replay", "lww_state", "prefix_scan", "prefix_count", "watch_changes", "watch_fanout", "cas_set", "hlc_next_local", "hlc_on_receive",
    "lease_sessions", "lease_lifecycle", "lease_expiry_cascade", "segment_stats", "snapshot_plus_tail", "replica_merge", "wal_batches", "discovery_instances", "codec_roundtrip", "record_checksums",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
