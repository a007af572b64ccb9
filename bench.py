"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""
import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quillon.plans import catalogue

NAMES = ["literal_topk_bm25", "gated_search", "exact_search", "regex_search", "phrase_search", "token_stats", "chunks", "content_dedupe", "knn_cosine", "hybrid_rrf", "hybrid_search", "phrase_bm25", "regex_gate_terms", "upsert_latest"]


def main():
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    t = time.time()
    catalogue.index(spark, sf)  # written once, before any search, as an index is
    out = {"index_build": round(time.time() - t, 3)}
    for n in NAMES:
        took = []
        for _ in range(3):
            t = time.time()
            catalogue.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t)
        out[n] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf}))


if __name__ == "__main__":
    main()
