"""DataFrame-to-DataFrame operators: terms, vectors, clusters, summaries."""
