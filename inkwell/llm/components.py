"""Distributed union-find: connected components by alternating large-star and small-star steps.

Only DataFrame operations; every step is cut by a written table. A step aggregates before it joins, and
joins on nodes, so a node with very many neighbours is split like any skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, free_shuffles


def _stars(edges: DataFrame) -> DataFrame:
    """(v, m): every node's link moves to the least node around. ``edges``: v > u, distinct."""
    both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    large = both.join(least, "v").filter(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
    low = large.groupBy("v").agg(F.min("u").alias("m"))
    small = large.join(low, "v")
    return small.filter(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node that has an edge but the roots; root is the least node of the component.

    ``edges``: two columns of one comparable type, any order, repeats and loops allowed, no nulls.
    """
    a, b = edges.columns
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    now = scratch.cut(now, f"{name}-0")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 32)))).first())
    before, k = mark(now), 0
    while True:
        k += 1
        now = scratch.cut(_stars(now), f"{name}-{k}")
        after = mark(now)
        scratch.drop(f"{name}-{k - 1}")
        if k % 4 == 0:
            free_shuffles(scratch.spark)
        if after == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = after
