"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations and two joins by node; the driver only sees counts. Rounds end when the edges no longer
change; every round's edges are a written table, so a lost executor costs a round at most, and the last round's is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a > b). large: every larger neighbour of a node is tied to the node's smallest neighbour; small: the node and
    its smaller neighbours are."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .where("a <> b").distinct())
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), in any direction -> node, root: the smallest node of its component. Nodes without an edge to another
    node aren't listed; null ends are dropped."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # the xor and the sum of hashes tell whether any edge has changed
    marks = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")))
    before, mark = None, now.agg(*marks).first()
    while mark[0] and mark != before:  # the edges settle after some log2(nodes) rounds
        old, now = now, written(star(star(now, True), False), "edges")
        discard(old)
        before, mark = mark, now.agg(*marks).first()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
