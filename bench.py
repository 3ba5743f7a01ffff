"""Time the headline jobs and print one JSON line.

``BENCH_SF_DIR`` is the folder of test tables and ``BENCH_CPUS`` the number of local cores.
Every job writes all its rows to a sink that discards them. ``prepare_text`` fits the
vocabulary and writes the vectors once; ``neighbours`` to ``recommend_one`` start from them.
``BENCH_ONLY`` names single jobs.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks import adapters
from checks.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
JOBS = [
    "scan_reviews", "catalog_build", "sales_catalog_build", "review_parts", "vocabulary", "tfidf", "tfidf_segments",
    "prepare_text", "neighbours", "recommend_one", "shared_terms", "shap_pairs", "evaluation_report",
    "dataset_report", "semantic_topk", "chat_prompts", "train_test_split", "clean_text",
]


def run(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    if name == "prepare_text":
        adapters.text_neighbours(spark, SF_DIR)
        adapters.text_postings(spark, SF_DIR)
    else:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("shelfkin-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = os.environ.get("BENCH_ONLY", "").split() or JOBS
    seconds = {name: run(spark, name) for name in jobs}
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
