"""Connected components of a table of links, by alternating stars.

Each round lets every node point its larger neighbours at the least node of its
neighbourhood, then every node its smaller ones. Minima are aggregated before
they are exchanged. They meet the links again in joins that leave the links of
hubs where they are: a hub's minimum goes to all tasks, and there are HOT hubs
at most. Links never leave the executors, and each round's links are written to
the shared folder, so that a lost executor costs one round at most. The rounds
grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again, cut, join_hot, release


def _state(links: DataFrame) -> tuple:
    low = F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 32) - 1))
    return tuple(links.agg(F.count("*"), F.sum(low)).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)``: the least node that it reaches.

    Links have no direction and may be repeated; those with a null end or from
    a node to itself are left out, and a node without other links is not in
    the result. A table without links gives an empty one.
    """
    now = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k"), "least")
        large = cut(join_hot(both.where("v > u"), least, "u", "k", 2 * state[0]).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large-star")
        lowest = cut(again(large).groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("k")), "lowest")
        small = join_hot(large, lowest, "b", "k", state[0]).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        following = cut(small, "links")
        release(now, least, large, lowest)
        now, before = following, state
        state = _state(now)
        if state == before:
            break
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
