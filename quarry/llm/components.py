"""Connected components of a link table, as alternating large-star and small-star rounds.

Every round is two joins and two distinct aggregates over the links, written to the shared
folder; a node with very many links is one hash key of a sort-merge join (never a broadcast),
whose skewed side AQE splits. Nothing but a row count and a checksum per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch, growing


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b. Large star: link every larger neighbour of a node to the least
    of the node and its neighbours. Small star: link a node's smaller neighbours and the node
    itself to the least of them."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = (both.groupBy("a").agg(F.min("b").alias("m"))
                 .select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
        out = (both.join(growing(least), both["a"] == least["n"]).filter(F.col("b") > F.col("a"))
               .select(F.col("b").alias("a"), F.col("m").alias("b")))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        out = (links.join(growing(least), links["a"] == least["n"]).filter(F.col("b") != F.col("m"))
               .select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b): two long node ids, in any order, repeats allowed. Returns (node, component)
    for every node that has a link; component is the smallest id of the nodes reachable from it.
    Rows with a null or with a = b add no link. An empty table gives an empty result."""
    now = scratch.keep(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links")
    mark = None
    while True:
        new = scratch.keep(_stars(_stars(now, large=True), large=False), "stars")
        seen = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                     .first())
        scratch.drop(now)
        now = new
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
