"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litquarry.llm.common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: a node's larger neighbours move to the least of it and its neighbours. Small star: its smaller ones do, and it."""
    seen = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(seen.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low")), "star")
    met = seen.join(least, "a")
    if small:
        moved = met.select("b", "low").unionByName(least.select(F.col("a").alias("b"), "low"))
    else:
        moved = met.where(F.col("b") > F.col("a")).select("b", "low")
    return moved.where(F.col("b") > F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b): root is the smallest node that can be reached, itself included.

    Every step reads and writes tables in the shared folder; a node with very many links meets partial minima and
    joins that adaptive execution may split. Self links and repeated links change nothing; nodes are not null.
    """
    high_low = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(high_low, "links"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
        edges = written(_star(written(_star(edges, small=False), "large-star"), small=True), "small-star")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
