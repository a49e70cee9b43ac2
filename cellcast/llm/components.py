"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour on the smallest one; minima are pre-aggregated, the join may split hot nodes."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node.

    Rounds go on until the stars no longer change; each one is written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    state = None
    while True:
        edges = written(_star(_star(edges, True), False), "stars")
        # Once stable, every node hangs on its component's smallest: two sums tell any change.
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"),
            F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        ).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
