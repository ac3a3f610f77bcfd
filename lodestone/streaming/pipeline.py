"""Structured Streaming: the change stream projected by micro-batches, deduplicated counts, and retries with state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.common import best_per_key
from lodestone.plans.fixpoint import shared_dir, written

#: Buckets of a stream's state.
BUCKETS = 16


def changes(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The event table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed all that is available through `each`, with exactly-once bookkeeping in the checkpoint."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def projected(stream: DataFrame, base: str, buckets: int = BUCKETS) -> DataFrame:
    """The newest event of each user and kind of a stream, kept up micro-batch by micro-batch below `base`.

    The state lies in buckets by hash of the key. A batch reads and rewrites only the buckets that its keys fall in, under its own
    number, and then writes down which number each bucket has; so a repeated batch writes the same again, and a batch costs what
    its buckets hold, not the whole state. Called again on the same base, it goes on from what is there, and gives all of it where
    nothing is new. A stream that never had a batch gives an empty table.
    """
    spark, columns = stream.sparkSession, ["user_id", "event_type", "event_id", "ts", "value"]
    newest = lambda df: best_per_key(df, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])

    def merge(batch: DataFrame, number: int) -> None:
        known = versions(spark, base, number)
        new = written(newest(batch.select(*columns)).withColumn("bucket", F.pmod(F.xxhash64("user_id", "event_type"), F.lit(buckets)).cast("int")), "batch")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` rows
        old = [f"{base}/v{known[b]}/bucket={b}" for b in touched if b in known]
        if old:
            held = spark.read.schema(new.drop("bucket").schema).parquet(*old)
            new = new.unionByName(held.withColumn("bucket", F.pmod(F.xxhash64("user_id", "event_type"), F.lit(buckets)).cast("int")))
        newest(new).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/v{number}")
        known |= dict.fromkeys(touched, number)
        spark.createDataFrame(list(known.items()), "bucket int, number int").write.mode("overwrite").parquet(f"{base}/versions/batch={number}")

    run_batches(stream, merge, f"{base}/checkpoint")
    schema, last = stream.select(*columns).schema, versions(spark, base)
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base}/v{n}/bucket={b}" for b, n in sorted(last.items())])


def versions(spark: SparkSession, base: str, before: int | None = None) -> dict[int, int]:
    """The batch that wrote each bucket last, after all batches or those before one: what a stream that starts again goes on from."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/versions")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return {}
    rows = spark.read.schema("bucket int, number int, batch int").parquet(f"{base}/versions")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    found = rows.groupBy("bucket").agg(F.max_by("number", "batch").alias("number")).collect()  # a row a bucket
    return {r.bucket: r.number for r in found}


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and kind of the event table, as a stream."""
    return projected(changes(spark, sf_dir), f"{shared_dir(spark)}/lodestone-stream-{uuid.uuid4().hex}")


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: distinct events of each kind and day. Repeats within the watermark are dropped in the stream; its rows are appended once each, and the counts read what is there."""
    base = f"{shared_dir(spark)}/lodestone-stream-{uuid.uuid4().hex}"
    unique = changes(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "ts", "event_type", "value")
    query = unique.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
