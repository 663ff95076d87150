"""Times headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set input and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog_queries import registry  # noqa: E402
from shelfscope.session import session  # noqa: E402

HEADLINE = (
    "confirmed_gems", "cleaning_funnel", "cleaned_rows", "labels", "multi_hot_long", "feature_table", "vendor_counts",
    "split_hidden_gem", "scaled_features", "screened_catalog", "anomaly_signals", "exact_quantiles", "genre_supply_demand",
    "platform_correlations", "tfidf_vocabulary", "keyword_search", "reranked_search", "vector_search", "evaluation_run",
    "binary_metrics", "oversampled", "nearest_neighbours", "csv_scan",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    known = registry()
    spark.read.parquet(f"{sf}/part.parquet").write.format("noop").mode("overwrite").save()  # start the executors
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        known[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf, "spark": spark.version, "master": f"local[{cpus}]",
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "rows": {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("part", "lineitem", "documents", "embeddings")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
