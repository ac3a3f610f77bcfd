"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def components(edges: DataFrame, label: str = "components", rounds: int | None = None) -> DataFrame:
    """(id, component) for every endpoint of edges (a, b); component is the smallest id reachable.

    Neighbourhoods are never gathered: each step is a minimum per id (combined map-side) and a join. Rounds grow with the
    logarithm of the longest path. Self-loops and repeated edges do no harm; an empty table gives an empty one. With `rounds`
    it stops after so many: ids of one component may then have several labels, but never one label in two components.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before, done = None, 0
    while done != rounds:
        done += 1
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        # large star: every larger neighbour of u, and u, point to the smallest of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        large = cut(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small, label)
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    named = roots.unionByName(roots.select(F.col("component").alias("id"), "component"))
    return cut(named.groupBy("id").agg(F.min("component").alias("component")), label)
