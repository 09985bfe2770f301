"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(id, root) for each node of ``edges`` (a, b): root is the smallest id that can be reached.

    Each step is a combinable minimum for each node and a join, so a node with very
    many neighbours is no task of its own.  Stops when the edges are stars.
    """
    # Every edge points from the larger to the smaller end.
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = scratch.keep(now, f"{label}-0")
    step = 0
    # Done when every node has one edge, to a node without any.
    while not settled(now):
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        # Large star: the larger neighbours of a node go to its smallest.
        large = both.join(least, both["a"] == least["of"]).filter("b > of").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tail = large.join(low.withColumnRenamed("a", "of"), F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = tail.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = scratch.keep(small, f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node stands once on the left, or only on the right."""
    sides = edges.select("a", F.lit(1).alias("left"), F.lit(0).alias("right")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("left"), F.lit(1).alias("right"))
    )
    nodes = sides.groupBy("a").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    return nodes.filter("left > 1 OR (left > 0 AND right > 0)").isEmpty()
