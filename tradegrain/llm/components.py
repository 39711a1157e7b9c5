"""Connected components of a link table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest in its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return _clean(moved)


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return _clean(moved.union(least.select(F.col("a").alias("x"), F.col("m").alias("y"))))


def _clean(moved: DataFrame) -> DataFrame:
    ordered = moved.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return ordered.distinct()


def connected_components(links: DataFrame, first: str, second: str) -> DataFrame:
    """(node, root) for every node that a link of two different nodes names; root is the component's least node.

    Alternating large-star and small-star rounds, each stored in the checkpoint folder, until the links are
    stars. The number of rounds grows with the logarithm of the longest path. Joins are plain equi-joins, so a
    node with very many links is split by adaptive execution.
    """
    edges = _clean(links.select(F.col(first).alias("x"), F.col(second).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL"))
    edges = cut_lineage(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        # Stars: no node is both somebody's root and below another root, and each has one root.
        state = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        crowded = state.filter("n > 1").limit(1).count()
        chained = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        if not crowded and not chained:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
