"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.withColumnRenamed("low", "b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of different ``edges(a, b)`` with a > b has one edge up, or only edges from below."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max(F.expr("up > 1 OR (up > 0 AND down > 0)"))).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``; the component is its least node.

    Every node of an edge gets one row. Loops and repeated edges are allowed, rows
    with a null end are ignored. Both halves of each round are written to the shared
    folder, and only whether it left stars reaches the driver: stars are the result,
    so no round is made to see that it changes nothing. Minima are combined before
    the shuffle, so a hub with very many neighbours stays one small row per task.
    """
    pairs = stored(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = pairs.where("a != b")
    while not _are_stars(state):
        state = stored(_small_star(stored(_large_star(state))))
    rows = [state.select("a", "b"), state.select(F.col("b").alias("a"), "b"), pairs.where("a = b")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
