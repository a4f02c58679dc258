"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from hybridsearch.plans.queries import QUERIES, search_index
from hybridsearch.plans.views import queries as asked

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["prepare_corpus", "segment_lines", "term_frequencies", "bm25_idf", "sparse_top_k", "dense_top_k", "search_index", "retrieve", "batch_retrieve", "evaluate_results"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the index is made once and timed by itself; the searches after it find it
    queries = {n: QUERIES[n] if n in QUERIES else lambda spark, sf: search_index(spark, sf).idf for n in NAMES}
    try:
        from hybridsearch.llm.queries import QUERIES as more
    except ModuleNotFoundError:
        more = {}
    queries |= more
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name, query in queries.items():
        start = time.time()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    n = asked(spark, SF_DIR).count()
    rate = round(n / seconds["retrieve"], 2)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "retrieve_queries_per_sec": rate}))


if __name__ == "__main__":
    main()
