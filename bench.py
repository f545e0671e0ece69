"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1) has the tables; BENCH_CPUS (default: all) the threads. Each query is written to
the no-op sink, so all its rows and columns are computed; the best of two runs counts, after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from kgloom.plans import catalog

HEADLINE = ["degree_top10", "degree_distribution", "structure", "type_modularity", "hubs", "feature_clusters", "search_nodes", "view_filter_edges", "cluster_links", "k_hop", "connected_components", "label_propagation", "top_keywords", "weighted_keywords", "keyword_cooccurrence", "topic_coverage", "topic_trend", "best_topic_counts", "event_trends", "merged_edges", "stored_nodes", "label_scores"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["structure"](spark, sf_dir).collect()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs), 3)
    scale = re.search(r"sf([\d.]+)/?$", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
