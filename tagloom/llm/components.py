"""Connected components of a graph held as a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, release


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node that has an edge: root is the least node of its component.

    edges has columns a, b of one sortable type. Each step hangs neighbours onto the least one they know, so the number of steps grows
    with the logarithm of a component's size. Minima are combined before they are shuffled, and they are written down
    before they are joined, so that the join may split a node with very many neighbours. An empty table gives no rows;
    loops and repeated edges do no harm; edges with nulls are ignored.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = cut(both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        small = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        for old in (now, least, large, small):
            release(old)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
