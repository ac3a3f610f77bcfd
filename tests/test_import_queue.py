"""A run that stops in the middle is completed by the next one."""

import pytest
from pyspark.sql import functions as F

from lodestone.streaming.import_queue import Queue


def items(spark, n):
    return spark.createDataFrame([(f"i{k:03d}", k) for k in range(n)] + [("i000", 5)], "item string, ord long")


def shout(taken):
    return taken.select("item", F.upper("item").alias("outcome"))


def test_a_stopped_run_is_completed(spark, tmp_path):
    q = Queue(spark, f"file://{tmp_path}/queue")
    q.discover(items(spark, 25))
    calls = []

    def stops(taken):
        calls.append(taken.count())
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return shout(taken)

    with pytest.raises(RuntimeError, match="stopped"):
        q.run(stops, now=lambda: 100, seconds=50, batch=10)
    again = Queue(spark, f"file://{tmp_path}/queue")  # nothing but the folder is left of the first run
    assert again.report() == {"done": 10, "leased": 10, "queued": 5}
    again.discover(items(spark, 27))  # discovery is repeated, and finds two more
    seen = []

    def counted(taken):
        seen.extend(r.item for r in taken.collect())
        return shout(taken)

    left = again.run(counted, worker="second", now=lambda: 120, seconds=50, batch=4)
    assert again.report() == {"done": 17, "leased": 10} and left.where("status = 'leased'").count() == 10  # the first run's lease still holds
    again.run(counted, worker="second", now=lambda: 150, seconds=50, batch=40)
    final = {r.item: (r.status, r.outcome, r.worker, r.attempts) for r in again.state().collect()}
    assert len(seen) == len(set(seen)) == 17 and len(final) == 27
    assert all(v[:2] == ("done", k.upper()) and v[3] == 1 for k, v in final.items())
    assert sum(v[2] == "import" for v in final.values()) == 10


def test_failures_end_as_dead(spark, tmp_path):
    q = Queue(spark, f"file://{tmp_path}/queue", most=2)
    assert q.state().count() == 0 and q.report() == {}
    q.discover(items(spark, 4))
    q.run(lambda t: t.where("item != 'i002'").select("item", F.lit("ok").alias("outcome")))
    assert q.report() == {"done": 3, "dead": 1}
    assert q.state().where("status = 'dead'").first().attempts == 2


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    q = Queue(spark, f"file://{tmp_path}/queue")
    q.discover(items(spark, 3))
    q.lease("w", 0, 10, 2)
    (tmp_path / "queue" / "log" / "seq=00000001" / "_SUCCESS").unlink()  # the writer died before its batch was whole
    assert q.report() == {"queued": 3}
    q.run(shout)
    assert q.report() == {"done": 3}
