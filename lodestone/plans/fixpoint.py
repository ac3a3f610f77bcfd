"""Reachability by frontier joins: stops by itself on cyclic graphs, and survives lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and all runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """df written once to the shared folder and read back, so that later rounds don't repeat earlier ones."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/lodestone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended before
        pass


def reachable(seeds: DataFrame, edges: DataFrame, include_seeds: bool = True) -> DataFrame:
    """(seed, node) for all nodes reachable from each seed (column seed) along edges (source, target).

    Each round joins the frontier with the edges and drops pairs that are known; it ends when nothing is new.
    """
    edges = edges.select("source", "target").distinct()
    frontier = written(seeds.select("seed", F.col("seed").alias("node")).distinct())
    known = [frontier]
    while True:
        seen = known[0]
        for k in known[1:]:
            seen = seen.unionByName(k)
        step = frontier.join(edges, F.col("node") == F.col("source")).select("seed", F.col("target").alias("node")).distinct()
        frontier = written(step.join(seen, ["seed", "node"], "left_anti"))
        if not frontier.limit(1).count():
            break
        known.append(frontier)
    first = 0 if include_seeds else 1
    if len(known) <= first:
        return frontier
    out = known[first]
    for k in known[first + 1 :]:
        out = out.unionByName(k)
    return out
