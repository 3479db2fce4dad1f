"""Connected components of a table of links, by alternating stars; every round is a few shuffles of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import cut_lineage


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each node, and itself, to its least neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.where("v > u" if larger else "v < u").join(least, "u")
    moved = near.select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b"))
    if not larger:
        moved = moved.unionByName(least.select(F.least("u", "m").alias("a"), F.greatest("u", "m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b) that has a link; the root is the least node of its component.

    Links are made to point at ever smaller nodes until they are stars; hot nodes are aggregated before each shuffle. Only one
    number per round comes to the driver.
    """
    links = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("h")).first()
        if now == before or not now["n"]:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now
        links = cut_lineage(_star(_star(links, True), False))
