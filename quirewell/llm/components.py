"""Connected components of a graph of ids by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame, path: str, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; component is the smallest node reachable.

    Large and small stars alternate until nothing changes: each node's
    neighbours are hung on the smallest of them. A hub's neighbourhood is only
    ever reduced to its minimum (partial aggregation), never collected. Every
    round is written to ``path``.
    """
    now = keep(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), f"{path}/0")
    if now.isEmpty():
        return now.selectExpr("a AS node", "a AS component")
    state = None
    for i in range(1, most_rounds):
        # large star: every larger neighbour of a node joins the smallest of the node's neighbourhood
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: every node and its smaller neighbours join the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b")).distinct()
        now = keep(small, f"{path}/{i}")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"), F.countDistinct("b").alias("d")).first()
        if seen["n"] == seen["d"] and seen == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
        state = seen
    raise RuntimeError("components did not settle")
