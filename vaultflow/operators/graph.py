"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of links (a, b) reaches; nodes are longs.

    Large-star and small-star steps in turn: each links nodes to the least node near them, so paths shorten by half or more. The least
    neighbours are summed up before they are shuffled and written before they are joined, so that Spark can split a node with very many links."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        new = materialize(large.join(low, "u").select(ends.alias("e")).select("e.*").filter("u > v").distinct())
        discard(edges, least, large, low)
        edges = new
        # Each link has one end; once all nodes hang on a root, a step changes nothing.
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = state
