"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from offerloom.plans.lineage import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: connect each node's larger neighbours to its smallest; small: its smaller neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        out = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """From links (a, b) between ids: node, component (the smallest id reachable). Nodes without a link are not listed.

    Loops and repeated links change nothing. Every step is a shuffle of the links; nothing is gathered on the driver. A star
    has one row per node, and a join of its rows with the minima can be split where a node has very many neighbours.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        after = cut(_stars(_stars(edges, True), False), "stars")
        n, same = after.count(), after.join(edges, ["a", "b"], "left_semi").count()
        done = n == same == edges.count()
        edges = after
        if done:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
