"""Connected components of a link table, by star rounds: no group is gathered, and the number of rounds grows with the logarithm of the paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import cut_lineage


def _least(links: DataFrame) -> DataFrame:
    """Each node's least neighbour, or itself where it is less."""
    return links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links`` ``(a, b)``; the root is the least node that it is linked to, by however many steps.

    Each round points the greater neighbours of a node to the least one, then the lesser ones; links only ever point to lesser nodes,
    until every node points to its root. Minima are taken before the shuffle, so a node with very many links is no hot group.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    down = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        around = _both(down)
        up = around.join(_least(around), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        tied = up.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        down = cut_lineage(tied.distinct())
        state = down.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == seen:
            break
        seen = state
    return nodes.join(down.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
