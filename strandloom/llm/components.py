"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    Every node hangs its larger neighbours on its smallest one, then its smaller
    ones; the steps alternate until nothing changes, in about log(n) rounds.  Each
    round is a grouping by node with map-side minima and a written table, so no
    neighbourhood is held in memory and lost executors cost one round at most.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = written(both, "links")
    before = None
    while True:
        # Large star: the larger neighbours of a node go to the smallest of it and its neighbours.
        around = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the smaller neighbours of a node, and the node, go to the smallest of them.
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        both = written(small, "links")
        state = both.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = both.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
