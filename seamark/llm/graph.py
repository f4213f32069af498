"""Connected components as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, if_small

MAX_ROUNDS = 60
#: Edges of a node from which on it is joined apart, so that its edges needn't meet in one task.
HOT = 256


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (a, b) with m of ``least`` (a, m, n: its edges); edges of nodes with many stay where they are."""
    least = durable(least)
    hot = durable(least.where(F.col("n") > HOT).select("a", "m"))
    cold = edges.join(least.where(F.col("n") <= HOT).select("a", "m"), "a")
    return cold if hot.isEmpty() else cold.unionByName(edges.join(if_small(hot), "a"))


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (a, b: bigint) with the least node of their component: node, root.

    Large-star and small-star steps alternate: every node's larger neighbours, then its smaller
    ones, are linked to its least neighbour, until all edges are stars. Edges stay in
    DataFrames, each round's are written, and no node's neighbours are gathered in one place.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = durable(edges.distinct())
    said = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if tuple(mark) == said or not mark[0]:
            break
        said = tuple(mark)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = durable(_with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        # a node's other smaller neighbours go to its least one; the node itself too
        small = _with_least(large, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = durable(small.where("a <> b").distinct())
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
