"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.select("a", "b").unionByName(turned)


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    ways = _both_ways(links)
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return (
        ways.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("root").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    own = least.select("a", F.col("root").alias("b"))
    return own.unionByName(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node; the root is its component's least id.

    ``links`` has ``a, b``.  A round shuffles the links by node, with minima
    combined before the shuffle, and rounds grow with the logarithm of the
    longest chain.  Each round is written to the shared folder.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        links = stored(_small_star(_large_star(links)), "links")
        now = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
