"""Connected components by alternating star contraction, each round a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.llm.store import drop, table


def _toward_least(edges: DataFrame, near: str, far: str, strict: bool) -> DataFrame:
    """Link every neighbour ``far`` of ``near`` to the least node of that neighbourhood."""
    least = table(edges.groupBy(near).agg(F.min(far).alias("least")))
    least = least.select(F.col(near).alias("key"), F.least(near, "least").alias("least"))
    joined = edges.join(least, edges[near] == least["key"])
    kept = joined.filter(F.col(far) > F.col(near)) if strict else joined
    return kept.select(F.col(far).alias("a"), F.col("least").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of long node ids to (node, component): the least node each is joined with.

    Nodes without an edge are not listed; null ends, loops and repeated edges add nothing. Runs until
    no edge changes: the number of rounds grows with the logarithm of the longest path.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = table(edges.filter("a <> b").select(a, b).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node move to the least of its neighbourhood.
        large = table(_toward_least(both, "a", "b", strict=True).filter("a <> b").distinct())
        # Small star: a node and its lesser neighbours move to the least of these.
        least = table(large.groupBy("a").agg(F.min("b").alias("least")))
        moved = large.join(least.withColumnRenamed("a", "key"), F.col("a") == F.col("key"))
        moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
        following = table(moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct())
        drop(now, large, least)
        now = following
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
