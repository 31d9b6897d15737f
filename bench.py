"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The files are written before the clock starts; each query runs once to warm up and counts its
best of three. mb_per_s is uncompressed slot bytes a second of full reads.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from pyspark.sql import SparkSession  # noqa: E402

import sav_queries as q  # noqa: E402
from quadrat.plans.api import read_sav  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FIVE = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    runs = {}
    for codec, name in (("none", "raw"), ("bytecode", "bytecode"), ("zlib", "zsav")):
        path = q.sav_file(spark, SF_DIR, "lineitem", codec)
        size = 8 << 20
        runs[f"full_{name}"] = lambda p=path: sink(read_sav(spark, p, partition_bytes=size)[0])
        runs[f"five_columns_{name}"] = lambda p=path: sink(read_sav(spark, p, columns=FIVE, partition_bytes=size)[0])
        runs[f"head_1000_{name}"] = lambda p=path: sink(read_sav(spark, p, n_rows=1000)[0])
        runs[f"five_head_1000_{name}"] = lambda p=path: sink(read_sav(spark, p, columns=FIVE, n_rows=1000)[0])
        runs[f"pricing_summary_{name}"] = lambda c=codec: sink(q.pricing_summary(spark, SF_DIR, c))
    for name in ("filter_date", "wide_file", "vls_documents", "label_decode_join", "weighted_count", "meta_diff_labels"):
        runs[name] = lambda n=name: sink(q.QUERIES[n](spark, SF_DIR))
    for path in ("orders", "embeddings", "texts"):
        q.sav_file(spark, SF_DIR, path, "zlib" if path != "embeddings" else "none")

    seconds = {}
    for name, run in runs.items():
        run()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        seconds[name] = round(min(took), 4)
    slot_mb = os.path.getsize(q.sav_file(spark, SF_DIR, "lineitem", "none")) / 1e6
    rates = {n: round(slot_mb / s, 1) for n, s in seconds.items() if n.startswith("full_")}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "mb_per_s": rates, "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
