"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placehull.session import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the least node among them and it.

    A large star moves the greater neighbours, a small star the node and its lesser neighbours.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    moved = both.filter("b > a") if large else both
    hung = moved.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        hung = hung.unionByName(least.select("a", F.col("low").alias("b")))
    return hung.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for each node of ``edges`` (a, b).

    Alternates large and small stars until the edges no longer change; the number of rounds grows with the logarithm of
    the size of a component. Each round is written, so a lost executor repeats one round at most; one row of
    counts per round reaches the driver.
    """
    edges = stage(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        edges = stage(_stars(_stars(edges, True), False), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
