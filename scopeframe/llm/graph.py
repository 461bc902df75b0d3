"""Connected components by alternating large and small stars; no driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the least node of the component.

    A round replaces edges by edges to the neighbourhood's least node. Both sides of each join are written tables, so that
    Spark can split the join of a node with very many neighbours."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.materialise(now, "edges")
    said = None
    for _ in range(MOST_ROUNDS):
        # large star: the larger neighbours of each node go to the least of its neighbourhood
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = common.materialise(large, "large-star")
        # small star: the smaller neighbours of each node, and itself, go to the least of them
        least = common.materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = common.materialise(now, "small-star")
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == said or total[0] == 0:
            break
        said = total
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
