"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.runtime import drop_table, persist_table


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each node, written.

    Written, since a join straight behind an aggregation keeps its partitioning,
    and then all edges of a hub are one task's.  From a table, Spark broadcasts
    what is small enough and otherwise splits the hubs that are too large.
    """
    return persist_table(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each larger neighbour of a node linked with the smallest of it and its neighbours; and a table to drop afterwards."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return moved, least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each smaller neighbour of a node, and the node, linked with the smallest neighbour; and a table to drop afterwards."""
    down = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v"), least


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge; the component is its smallest node.

    Every node keeps one row for each tree edge, so no group is collected; each
    round is cut off by a written table, and rounds grow with the logarithm of
    the longest path.
    """
    now = persist_table(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        large, first = _large_star(now)
        grown = persist_table(large.distinct(), "edges")
        small, second = _small_star(grown)
        step = persist_table(small.distinct(), "edges")
        mark = step.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        for t in (now, first, grown, second):
            drop_table(t)
        now = step
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
