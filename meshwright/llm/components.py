"""Connected components of a table of links, by alternating large and small stars.

Every round is written to the shared folder, so it survives a lost executor and its lineage stays short. The rounds grow with the
logarithm of a component's diameter, and the tables with the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

MOST_ROUNDS = 60


def large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links has long columns a and b in any order. Gives node, root (the least node of its component) for every node that is not its own root."""
    now = write_table(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(MOST_ROUNDS):
        seen = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("bigint")), F.lit(0)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
        now = write_table(small_star(large_star(now)), "links")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
