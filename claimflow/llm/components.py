"""Connected components of a graph of ids, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.store import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the node's smallest neighbour or the node itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung below the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    hung = edges.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`edges` has a and b (bigint). Returns node and root, the smallest id its component holds.

    Each round is a fixed number of joins and groupings on the ids and is written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain. Only a count and
    a checksum reach the driver. Loops and repeated edges do no harm; nodes without an edge to
    another are not listed.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, before = stored(now, "edges"), None
    while True:
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not sums[0] or sums == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = sums
        now = stored(_small_star(_large_star(now)), "edges")
