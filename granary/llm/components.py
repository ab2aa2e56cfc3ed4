"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import join_groups, settled


ROWS = 100_000


def connected(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Rows (node, root) for every end of a link (a, b): root is the least node of its component.

    Large and small stars by turns: every node ties its larger neighbours to the least node that it sees, then ties
    its smaller ones to it, until nothing changes; the number of rounds grows with the logarithm of the longest path.
    Only minima are taken for each node, never lists, and the links of a node with many are dealt to all tasks.
    Null ends and loops do not count.
    """
    edges, n = settled(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), ROWS)
    seen = None
    for _ in range(most_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, n = settled(_tied(both, 2 * n, F.least("u", F.min("v")), F.col("v") > F.col("u")), ROWS, n)
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        edges, n = settled(_tied(large, n, F.min("v")).filter("u <> v").unionByName(least).distinct(), ROWS, 2 * n)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _tied(edges: DataFrame, total: int, least: Column, which: Column | None = None) -> DataFrame:
    """(v, the least of u's links) for the links (u, v) that `which` picks, or all."""
    stars = edges.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n"))
    return join_groups(edges if which is None else edges.filter(which), stars, "u", F.col("n"), total).select(F.col("v").alias("u"), F.col("m").alias("v"))
