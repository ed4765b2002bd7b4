"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   input tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 2)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from postflow.plans import queries as registered
from postflow.session import build_session

HEADLINE = (
    "normalize_text",
    "content_key",
    "analyze_default",
    "analyze_warm_cache",
    "sentiment_by_lang",
    "merge_metrics",
    "put_rows",
    "merge_partial_doc",
    "to_document",
    "author_lookup",
    "hydrate",
    "date_histogram",
    "terms",
    "terms_multi",
    "metric_stats",
    "token_freq",
    "inverted_index",
    "match_all",
    "stream_dedupe",
    "stream_merge",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    spark = build_session("postflow-bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered.queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
