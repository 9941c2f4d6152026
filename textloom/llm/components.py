"""Connected components of an edge table, by alternating large and small stars.

Edges shrink to stars around the least node of each component in a number of rounds that
grows with the logarithm of the component, each one a minimum per node (combined before
its shuffle) and a join (which can be split where a node is hot). Every round is a table in
the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.sources.tables import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them and the node itself."""
    ways = edges.where("a <> b")
    if large:
        ways = ways.union(ways.select("b", "a"))
    else:
        ways = ways.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = ways.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge: the least node of its component.

    ``edges`` has columns a and b. Loops and repeated edges do no harm.
    """
    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        edges = checkpoint(_star(_star(edges, True), False))
        sums = [F.sum(F.hash(c).cast("long")) for c in ("a", "b")]
        state = edges.agg(F.count("*"), *sums, F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == before:
            break
        before = state
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
