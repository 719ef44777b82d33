"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being its smallest node.

    Alternates the large-star and the small-star step until the edges stop changing: every edge
    then joins a node to the smallest of its component. Each step is one aggregation for the
    smallest neighbour and one join, with partial sums before the shuffle, so a node with very many
    neighbours costs no task more than its share of the edges; adaptive execution splits the rows
    of such a node in the join. The edges of each round are written to the shared folder.
    Nodes may be of any type that has an order. The rounds end, as each lowers the sum of the nodes' ranks
    until nothing changes. Rows with a null are ignored. Empty edges give an empty result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct()
    pairs = table(pairs, "edges")
    before = None
    while True:
        both = pairs.select("u", "v").union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs, old = table(small, "edges"), pairs
        free(old)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return found.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(found.select("node"), "node", "left_anti"))
