"""Wall time and shuffle bytes of the headline queries; prints one JSON line.

Every query runs once to warm up; then its median of ``BENCH_RUNS`` (default 3) warm runs counts, or one
warm run where the first took over 20 s.  ``shuffle_mb`` is what one warm run writes to shuffles.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fieldpulse.plans.queries import QUERIES
from fieldpulse.session import build_session

HEADLINE = [
    "topic_year_stats", "emerging_signals", "topic_transitions", "coauthor_edges", "label_propagation",
    "modularity", "npmi_coherence", "tfidf", "kmeans", "lda_topics", "evidence_search", "ingest_works",
    "emerging_backtest", "detected_communities",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def shuffle_bytes(spark) -> int:
    """Bytes that all executors have written to shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times, shuffles = {}, {}
    for name in names:
        repeats = 1 if run(spark, name, folder) > 20 else runs
        before = shuffle_bytes(spark)
        times[name] = round(statistics.median([run(spark, name, folder) for _ in range(repeats)]), 3)
        shuffles[name] = round((shuffle_bytes(spark) - before) / repeats / 2 ** 20, 1)
        print(f"{name} {times[name]} s, {shuffles[name]} MB", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "shuffle_mb": shuffles, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
