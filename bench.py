"""Times the headline queries, each run twice, the faster counts; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loam import catalog

HEADLINE = [
    "recall_topk",
    "rrf_ensemble",
    "fusion_weighted",
    "tfidf_search",
    "exact_dedup",
    "near_dup_pairs",
    "connected_components",
    "graph_traverse",
    "time_buckets",
    "type_pivot",
    "churn",
    "gap_markers",
    "trust_score",
    "latency_percentiles",
    "label_top_words",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, taken = catalog.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # the JVM is up
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        taken[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
