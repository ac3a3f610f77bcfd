"""Connected components of string-named nodes, by minima over neighbours with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.fixpoint import written


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b); every round halves the longest way or so."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = labels.join(near, "id").join(jump, "component", "left").select("id", F.least("component", "c", F.coalesce("next", "component")).alias("new"), "component")
        new = written(new, "labels")
        changed = new.where("new <> component").limit(1).count()
        labels = new.select("id", F.col("new").alias("component"))
        if not changed:
            return labels
