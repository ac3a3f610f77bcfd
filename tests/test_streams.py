"""Streams in several batches, stopped and started again, against one pass over all rows; the change index."""

import datetime
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import jobs, state
from lodestone.plans import change_index
from lodestone.plans.views import Views
from lodestone.streaming import pipeline, stateful


class Folder(Views):
    """The events of a folder of files."""

    def table(self, name):
        return self.spark.read.parquet(self.sf_dir)


def parts(spark, tiny, folder, count):
    """The events in files by time, the first here, the others to come."""
    e = spark.read.parquet(f"{tiny}/events.parquet").withColumn("part", F.ntile(count).over(Window.orderBy("ts", "event_id")))
    for k in range(1, count + 1):
        e.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{folder}/later{k}")


def arrive(folder, k):
    os.makedirs(f"{folder}/in", exist_ok=True)
    name = next(n for n in os.listdir(f"{folder}/later{k}") if n.endswith(".parquet"))
    os.rename(f"{folder}/later{k}/{name}", f"{folder}/in/{k:03d}.parquet")
    os.utime(f"{folder}/in/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def stream_of(spark, folder):
    schema = spark.read.parquet(f"{folder}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("kind", ["retries", "breakers", "claims"])
def test_streams_with_state(spark, tiny, tmp_path, kind):
    parts(spark, tiny, tmp_path, 4)
    for k in (1, 2):
        arrive(tmp_path, k)
    stateful.run_stateful(stream_of(spark, tmp_path), kind, f"{tmp_path}/base")
    for k in (3, 4):  # the stream was stopped, and starts again
        arrive(tmp_path, k)
    got = stateful.run_stateful(stream_of(spark, tmp_path), kind, f"{tmp_path}/base")
    v = Folder(spark, f"{tmp_path}/in")
    if kind == "retries":
        wanted = jobs.retries(v)
    elif kind == "breakers":
        wanted = jobs.breaker_states(v)
    else:
        wanted = state.granted_claims(v.table("events").select(F.col("user_id").alias("ref"), F.col("event_id").alias("id"), F.col("ts").alias("at")))
    rows = lambda df: sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    assert rows(got) == rows(wanted) and got.count() > 0


def test_projection_goes_on_after_a_restart(spark, tiny, tmp_path):
    parts(spark, tiny, tmp_path, 3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    wanted = lambda: rows(jobs.project_events(spark.read.parquet(f"{tmp_path}/in")))
    arrive(tmp_path, 1)
    assert rows(pipeline.projected(stream_of(spark, tmp_path), f"{tmp_path}/base")) == wanted()
    assert rows(pipeline.projected(stream_of(spark, tmp_path), f"{tmp_path}/base")) == wanted()  # nothing new
    for k in (2, 3):
        arrive(tmp_path, k)
    assert rows(pipeline.projected(stream_of(spark, tmp_path), f"{tmp_path}/base")) == wanted()


def test_change_index(spark, tmp_path):
    day = lambda n, h=0: datetime.datetime(2024, 1, n, h)
    objects = spark.createDataFrame([("a", day(1), []), ("b", day(5), []), ("c", day(9), []), ("d", day(2), ["bad"]), ("e", day(9), ["bad"])], "digest string, changed_at timestamp_ntz, findings array<string>")
    names = lambda df: sorted(r.digest for r in df.collect())
    log = f"{tmp_path}/log"
    assert names(change_index.changed(objects, log)) == list("abcde")
    assert names(change_index.changed(objects, log, "2024-01-04 00:00:00")) == list("bcde")  # no log: all are scanned, and it is filled
    assert names(spark.read.parquet(log)) == ["b", "c"]
    change_index.record(spark.createDataFrame([("a", day(1)), ("c", day(9, 5)), ("c", day(9, 6)), ("gone", day(9))], change_index.SCHEMA), log)
    assert names(change_index.changed(objects, log, "2024-01-04 00:00:00")) == ["b", "c"]  # what the log names
    later = objects.withColumn("changed_at", F.when(F.col("digest") == "c", F.col("changed_at")).otherwise(F.lit(day(1))))
    assert names(change_index.changed(later, log, "2024-01-04 00:00:00")) == ["c"]  # logged, but an older state now
    plan = change_index.logged(spark, log, "2024-01-08 00:00:00")
    files = [f for f in plan.inputFiles() if "day=" in f]
    assert "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()
    read = plan.select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read < len(files)
