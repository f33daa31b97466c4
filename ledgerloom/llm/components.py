"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a node with many neighbours is pre-aggregated and
its join can be split; every round is written to the shared folder. Rounds end when the edges are
stars around each component's least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged


def _is_star_forest(pairs: DataFrame) -> bool:
    """Whether every u of pairs (u, v) has one v, which is no u itself."""
    n, kinds = pairs.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == kinds and pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable."""
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = staged(pairs, tag)
    while not _is_star_forest(pairs):
        both = pairs.select(F.col("u").alias("n"), F.col("v").alias("m")).union(pairs.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.join(least, "n").where("m > n AND m <> low").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(root, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        pairs = staged(moved.union(root.select("u", F.col("low").alias("v"))).distinct(), tag)
    ends = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)
