"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.session import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable.

    Large stars hang every larger neighbour on a node's smallest neighbour, small
    stars the smaller ones, until nothing moves; minima are combined before the
    shuffle, so a node with very many neighbours costs no more than its edges.
    Self loops and repeated edges are harmless; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    pairs = written(pairs)
    state = _state(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        pairs = written(moved.union(lower.select("a", F.col("m").alias("b"))).distinct())
        now = _state(pairs)
        if now == state:
            break
        state = now
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
