"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query is run to
completion into a sink that discards rows, so nothing is sampled or cut short.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from corroborate.plans import REGISTRY

HEADLINE = [
    "ground_benchmark",
    "ground_quotes",
    "grounding_gate",
    "norm_quality",
    "token_sets",
    "visible_text",
    "resolve_entities",
    "merge_cluster",
    "classify",
    "marker_coverage",
    "similar_pairs",
    "overreach",
    "novelty_curve",
    "uncovered_phrases",
    "review_coverage",
    "cell_scores",
    "greedy_admission",
    "reading_plan",
    "rolling_novelty",
    "monthly_rollup",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corroborate-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
