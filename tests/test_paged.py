"""The paged mail source: full listing, history, restarts without loss or repeats, expired cursors."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.sources import paged


def messages(spark, ids):
    return spark.createDataFrame([(f"m{i}", i % 3, "user", f"text {i}" if i % 5 else None, i) for i in ids], "message_id string, thread_id bigint, role string, text string, sent long")


def taken(df):
    return sorted((int(r.message_id[1:]), r.text) for r in df.collect())


def test_full_listing_then_history(spark, tmp_path):
    address, base = f"file://{tmp_path}/service", f"file://{tmp_path}/base"
    following = paged.publish(messages(spark, range(230)), address, 0)
    assert following >= 3
    got = paged.pull(spark, address, base)
    assert taken(got) == [(i, f"text {i}" if i % 5 else None) for i in range(230)]
    assert paged.pull(spark, address, base).count() == 230  # nothing new
    following = paged.publish(messages(spark, range(230, 300)), address, following)
    assert [i for i, _ in taken(paged.pull(spark, address, base))] == list(range(300))
    # pages that were taken may go
    for name in sorted(os.listdir(f"{tmp_path}/service"))[:2]:
        shutil.rmtree(f"{tmp_path}/service/{name}")
    paged.publish(messages(spark, range(300, 310)), address, following)
    assert [i for i, _ in taken(paged.pull(spark, address, base))] == list(range(310))


def test_history_mode_and_expired_cursor(spark, tmp_path):
    address = f"file://{tmp_path}/service"
    following = paged.publish(messages(spark, range(90)), address, 0, per_page=30)
    got = paged.pull(spark, address, f"file://{tmp_path}/a", mode="history", historyAnchor="0")
    assert got.agg(F.min("page")).first()[0] == 1 and got.count() < 90
    shutil.rmtree(f"{tmp_path}/service/page-00000000.parquet")
    shutil.rmtree(f"{tmp_path}/service/page-00000001.parquet")
    with pytest.raises(Exception, match="expired"):
        paged.pull(spark, address, f"file://{tmp_path}/b", mode="history", historyAnchor="0")
    full = paged.pull(spark, address, f"file://{tmp_path}/c")
    assert 0 < full.count() < 90 and following >= 3
    with pytest.raises(Exception, match="history"):
        paged.pull(spark, address, f"file://{tmp_path}/d", mode="history")


def test_a_stopped_query_repeats_nothing(spark, tmp_path):
    """A batch that was planned but did not end is read again from its own offsets."""
    address, base = f"file://{tmp_path}/service", f"{tmp_path}/base"
    paged.publish(messages(spark, range(60)), address, 0, per_page=20)
    spark.dataSource.register(paged.PagedMail)
    stream = spark.readStream.format("paged_mail").option("path", address).load()

    def fail(batch, number):
        raise RuntimeError("stopped")

    query = stream.writeStream.foreachBatch(fail).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped"):
        query.awaitTermination()
    seen = []
    query = stream.writeStream.foreachBatch(lambda b, n: seen.extend(r.message_id for r in b.collect())).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(seen) == sorted(f"m{i}" for i in range(60))
