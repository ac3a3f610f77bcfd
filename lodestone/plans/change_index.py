"""The change index: a log of which object changed when, in folders by day, that a projection of changed objects starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.fixpoint import written

SCHEMA = "digest string, changed_at timestamp_ntz"


def record(changes: DataFrame, path: str) -> None:
    """Append changes (digest, changed_at) to the log: a folder a day, files sorted by time; an object's repeated changes of a day are one, the last."""
    day = F.to_date("changed_at")
    rows = changes.select("digest", "changed_at", day.alias("day")).groupBy("digest", "day").agg(F.max("changed_at").alias("changed_at"))
    rows.repartition("day", F.pmod(F.xxhash64("digest"), F.lit(8))).sortWithinPartitions("day", "changed_at").write.mode("append").partitionBy("day").parquet(path)


def logged(spark: SparkSession, path: str, since: str) -> DataFrame:
    """digest, changed_at of the log from a time on; folders of earlier days are not read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    at = F.lit(since).cast("timestamp_ntz")
    log = spark.read.schema(f"{SCHEMA}, day date").parquet(path)
    return log.where((F.col("day") >= F.to_date(at)) & (F.col("changed_at") >= at)).select("digest", "changed_at")


def changed(objects: DataFrame, path: str, since: str = "") -> DataFrame:
    """The rows of objects (digest, changed_at, findings, ...) that changed after `since` or have findings.

    An empty time asks for all of them. Otherwise the log names the objects to look at, each once, however often it is logged; objects
    that are gone are left out. Where the log has nothing from that time on, all objects are scanned, and what changed without
    findings is written to the log, so that the next call finds it there.
    """
    if not since:
        return objects
    spark, at = objects.sparkSession, F.lit(since).cast("timestamp_ntz")
    due = (F.size("findings") > 0) | (F.col("changed_at") > at)
    log = written(logged(spark, path, since).select("digest").distinct(), "changes")
    if log.limit(1).count():
        return objects.join(log, "digest", "left_semi").where(due)
    found = written(objects.where(due), "changed")
    record(found.where(F.size("findings") == 0), path)
    return found
