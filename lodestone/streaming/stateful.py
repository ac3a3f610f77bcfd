"""Jobs as streams with state: retries and dead letters, circuit breakers, claims that run out.

Each processor keeps a few numbers a key in the state store. A key's rows of a micro-batch are taken in their order in time, and what
the batch before left goes on; so a stream in any number of batches, stopped and started again between them, gives what one pass
over all rows gives, if no row comes after a later one of its key. State that a claim no longer needs is dropped by a timer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lodestone.operators.jobs import Breaker

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows):
    """A key's rows of a batch by time and id."""
    import pandas as pd

    parts = list(rows)
    return pd.concat(parts).sort_values(["ts", "event_id"])


class Retries(StatefulProcessor):
    """Failures in a row wait base * 2^(n-1) seconds and are dead letters beyond `most`; a success forgets them."""

    def __init__(self, base_seconds: int = 10, most: int = 5):
        self.base, self.most = base_seconds, most

    def init(self, handle) -> None:
        self.failed = handle.getValueState("failed", "n int")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        n, out = self.failed.get()[0] if self.failed.exists() else 0, []
        for e, ok in _in_order(rows)[["event_id", "ok"]].itertuples(index=False):
            if ok:
                n = 0
                continue
            n += 1
            dead = n > self.most
            out.append((e, n, "dead_letter" if dead else "retry", None if dead else self.base * 2 ** (n - 1)))
        if n:
            self.failed.update((n,))
        else:
            self.failed.clear()
        yield pd.DataFrame(out, columns=["event_id", "attempt", "action", "delay"]).astype({"event_id": "int64", "attempt": "int32", "action": "object", "delay": "Int64"})

    def close(self) -> None:
        pass


class Breakers(StatefulProcessor):
    """One breaker a key; see jobs.Breaker. Only one that has failed has state."""

    def init(self, handle) -> None:
        self.kept = handle.getValueState("breaker", "failed int, opened int, until double, probing boolean")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        breaker, out = Breaker(), []
        if self.kept.exists():
            breaker.failed, breaker.opened, breaker.until, breaker.probing = self.kept.get()
        for e, at, ok in _in_order(rows)[["event_id", "at", "ok"]].itertuples(index=False):
            allowed = breaker.allow(at / 1e6)
            if allowed:
                breaker.record(bool(ok), at / 1e6)
            out.append((e, key[0], allowed, breaker.state))
        if breaker.failed or breaker.opened:
            self.kept.update((breaker.failed, breaker.opened, float(breaker.until), breaker.probing))
        else:
            self.kept.clear()
        yield pd.DataFrame(out, columns=["event_id", "backend", "allowed", "state"])

    def close(self) -> None:
        pass


class Claims(StatefulProcessor):
    """The first attempt of a key claims it, and then the first more than ttl_seconds after the last claim. A timer drops what has run out."""

    def __init__(self, ttl_seconds: int = 15 * 60):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("claimed", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        last, out = self.last.get()[0] if self.last.exists() else None, []
        for e, at, ts in _in_order(rows)[["event_id", "at", "ts"]].itertuples(index=False):
            if last is None or at > last + self.ttl:
                last = at
                out.append((key[0], e, ts))
        if out:
            self.last.update((last,))
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)
        yield pd.DataFrame(out, columns=["ref", "id", "claimed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        if self.last.exists() and (self.last.get()[0] + self.ttl) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame({"ref": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "claimed": pd.Series(dtype="datetime64[us]")})

    def close(self) -> None:
        pass


PROCESSORS = {
    "retries": (Retries, "event_id bigint, attempt int, action string, delay bigint", "None"),
    "breakers": (Breakers, "event_id bigint, backend bigint, allowed boolean, state string", "None"),
    "claims": (Claims, "ref bigint, id bigint, claimed timestamp_ntz", "EventTime"),
}


def attempts(events: DataFrame) -> DataFrame:
    """event_id, job, ts, ok, at (microseconds) of a stream of events."""
    ts = F.col("ts").cast("timestamp")
    return events.select("event_id", F.col("user_id").alias("job"), "ts", ts.alias("event_time"), (F.col("event_type") != "purchase").alias("ok"), F.unix_micros(ts).alias("at"))


def run_stateful(stream: DataFrame, kind: str, base: str, **options: int) -> DataFrame:
    """Feed what is available of a stream of events through a kind of processor; the rows that it gave so far. Called again on the same
    base it goes on where it stopped, with the state that it had."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    make, schema, mode = PROCESSORS[kind]
    rows = attempts(stream)
    if mode == "EventTime":
        rows = rows.withWatermark("event_time", "1 second")
    out = rows.groupBy("job").transformWithStateInPandas(statefulProcessor=make(**options), outputStructType=schema, outputMode="Append", timeMode=mode)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")
