"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the seconds of each (median of three)."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

NAMES = ["SCO01_score", "TMP01_hotspots", "TMP13_bus_factor", "TMP04_file_coupling", "DUP05_shared_windows", "DUP07_jaccard", "SCO04_subscores", "PRJ08_new_findings", "RUL10_pick_worst", "STA03_auroc", "STA06_delong", "STA07_roc_thresholds", "ARC03_propagation", "DET19_magic_numbers", "TMP14_knowledge_loss_index"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    from tidemark.plans.queries import QUERIES

    took = {}
    for name in NAMES:
        each = []
        for _ in range(3):
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - t)
        took[name] = round(statistics.median(each), 3)
    print(json.dumps({"metric": "headline queries, median of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
