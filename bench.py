"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local cores.
Each query is run to the end without collecting its rows. The value is the sum.
"""

from __future__ import annotations

import json
import os
import sys
import time

from textloom.queries.table import all_queries
from textloom.session import local_session

HEADLINE = (
    "tokens", "clean_text", "word_chunks", "overlap_chunks", "middle_extract", "midpoint_extract",
    "term_counts", "tf_idf", "top_terms", "bigram_tf_idf", "top_bigrams", "overall_frequency",
    "corpus_stats", "embed_hashed", "summarize", "summarize_long",
    "cosine_pairs", "top_similar", "similarity_stats", "silhouette", "kmeans_from", "kmeans",
    "cluster_keywords", "layout_2d", "ward_linkage", "elbow", "choose_k", "similar_hashed", "ward_micro",
    "cut_chain", "similarity_tiles",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, name="bench")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    # One small run starts the JVM's compiler and the Python workers.
    for name in ("top_terms", "kmeans_from"):
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
