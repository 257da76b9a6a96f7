"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with the least of ``a`` and all its neighbours. The minimum combines before the
    shuffle and the join is a plain equi-join, which AQE splits for a node with many edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").withColumn("m", F.least("a", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _with_least(_both_ways(edges)).where("b > a")
    return pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = _with_least(down)
    moved = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(pairs.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (two different longs, any direction);
    ``root`` is the smallest node that can be reached. Nodes without an edge do not appear.

    Every round is written to the shared folder. Only a count and a checksum reach the driver.
    An empty edge table gives an empty result.
    """
    edges, before = stored(edges.where("a <> b").select("a", "b"), "edges"), None
    while (now := _state(edges)) != before:
        before = now
        edges = stored(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
