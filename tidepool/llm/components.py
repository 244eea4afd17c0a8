"""Connected components of a graph that no task and no driver has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import packed, written
from tidepool.session import scratch_folder


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and its neighbours. A node with many neighbours is one row of
    the aggregated side; its many rows of the other side are split by the skew join."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _with_least(both.distinct()).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    small = _with_least(large)  # every u now points to smaller nodes
    return (small.select(F.col("v").alias("a"), F.col("least").alias("b")).union(small.select(F.col("u").alias("a"), F.col("least").alias("b")))
            .filter("a <> b").distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes that have an edge.

    Alternating stars: the number of rounds grows with the logarithm of the longest chain. Each
    round's edges are written to the shared folder. Loops and repeated edges do no harm; no edges,
    no rows.
    """
    folder, last, turn = scratch_folder(edges.sparkSession), None, 0
    current = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), folder, "edges")
    n = current.count()
    while n:
        turn += 1
        # a round never has more than twice the edges before it
        current = written(packed(_round(current), 2 * n), folder, f"round-{turn}")
        n = current.count()
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    return (current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
