"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is materialised with the ``noop`` sink (full execution, no collect), after one
warm-up run; the value per query is the median of ``BENCH_RUNS`` (default 3) warm runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quarry import get_spark  # noqa: E402
from quarry.operators import ann, knn as knn_ops  # noqa: E402
from quarry.plans import queries as Q  # noqa: E402

HEADLINE = ["chunkify", "embed_hash", "knn_exact", "html_text", "ingest_documents"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(times, name, runs, fn) -> None:
    """Median of ``runs`` warm runs."""
    fn()
    ts = []
    for _ in range(runs):
        t = time.perf_counter()
        fn()
        ts.append(time.perf_counter() - t)
    times[name] = round(statistics.median(ts), 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark()
    times = {}
    for name in HEADLINE:
        timed(times, name, runs, lambda: run(Q.QUERIES[name](spark, sf)))
    # corpus: build and search apart
    timed(times, "corpus_build", runs, lambda: Q.doc_corpus(spark, sf))
    corpus = Q.doc_corpus(spark, sf)
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), "text")
    timed(times, "search_topk", runs,
          lambda: run(corpus.search(asked, k=Q.K_SEARCH, strategy="broadcast")))
    # approximate search: build and search apart, plus recall against exact
    rows, q = Q._emb_tables(spark, sf)
    timed(times, "ivf_build", runs, lambda: ann.IvfIndex.build(rows, nlist=16))
    index = ann.IvfIndex.build(rows, nlist=16)
    timed(times, "knn_ivf", runs, lambda: run(index.search(q, k=10, nprobe=8)))
    recall = ann.recall_at_k(index.search(q, k=10, nprobe=8), knn_ops.knn(rows, q, k=10))
    m = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf,
                      "knn_ivf_recall_at_10": round(recall, 4), "runs": runs,
                      "cpus": int(os.environ.get("BENCH_CPUS", "8"))}))


if __name__ == "__main__":
    main()
