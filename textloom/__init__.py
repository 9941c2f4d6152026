"""Document-corpus analytics on Spark: terms, vectors, clusters and summaries."""
