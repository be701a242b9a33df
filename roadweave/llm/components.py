"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.shared import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is its least node.

    Alternates large-star and small-star steps, each a grouping by node, until no link
    changes; every round is stored in the shared folder. The rounds grow with the logarithm
    of the longest chain. Self-links and repeated links do no harm; no links give no rows.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc-links")
    while True:
        # Large star: every greater neighbour of u points at the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: u and its lesser neighbours point at the least of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(small_least, "u")
        small = pointed.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pointed.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        after = stored(small, "cc-links")
        changed = after.exceptAll(edges).limit(1).count() or edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "cc-nodes")
