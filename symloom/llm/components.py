"""Connected components by alternating large-star and small-star rounds.

Each round points every node at the smallest neighbour known to it, so the
number of rounds grows with the logarithm of the longest chain. Edges live in
DataFrames only; nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import drop_table, materialize, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): one row (node, root) per node that has an edge, root being the smallest node reachable.

    Self-loops are dropped. An empty input gives an empty result.
    """
    now = edges.select("a", "b").filter("a <> b").distinct()
    before = previous = None
    while True:
        now = materialize(_small_star(_large_star(now)), "stars")
        if previous is not None:
            drop_table(edges.sparkSession, previous)
        previous = written()[-1]
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
