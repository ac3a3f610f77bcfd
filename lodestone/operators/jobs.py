"""Event-driven work: job derivation, keys and priorities, pending reconcile, retries, backpressure, breakers, changes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import joined_hash
from lodestone.operators.common import best_per_key
from lodestone.plans.views import Views

FAILED = ("failed", "error", "invalid")
#: (analyzer, version, media types that it wants; none: all)
SPECS = [("quality", "1", ["text/plain"]), ("toxicity", "2", ["text/plain", "message/rfc822"]), ("outline", "1", [])]


def derive(v: Views, specs: Sequence[tuple[str, str, Sequence[str]]] = SPECS, forced: Sequence[str] = ()) -> DataFrame:
    """digest, analyzer, version, reason, priority, job_key of every job that is due."""
    dim = v.spark.createDataFrame([(a, ver, list(m)) for a, ver, m in specs], "analyzer string, want string, media array<string>")
    o = v.objects().select("digest", "media_type")
    asked = o.crossJoin(F.broadcast(dim)).where((F.size("media") == 0) | F.array_contains("media", F.col("media_type")))  # the specs are arguments
    j = asked.join(v.analysis().select("digest", "analyzer", "version", "status"), ["digest", "analyzer"], "left")
    reason = F.when(F.col("analyzer").isin(*forced), "forced") if forced else F.when(F.lit(False), "forced")
    reason = reason.when(F.col("version").isNull(), "missing").when(F.col("version") != F.col("want"), "stale").when(F.col("status").isin(*FAILED), "repair")
    j = j.withColumn("reason", reason).where("reason is not null")
    priority = F.when(F.col("reason") == "forced", 2).when(F.col("reason") == "repair", 1).otherwise(0)
    return j.select("digest", "analyzer", F.col("want").alias("version"), "reason", priority.alias("priority"), joined_hash("digest", "analyzer", "want").alias("job_key"))


def outcomes(v: Views) -> DataFrame:
    """event_id, job, ts, ok: the stream of job outcomes; every event is one attempt of a user's job."""
    return v.table("events").select("event_id", F.col("user_id").alias("job"), "ts", (F.col("event_type") != "purchase").alias("ok"), "event_type")


def reconcile(v: Views) -> DataFrame:
    """outcome, n of pending jobs: satisfied ones and repeated keys are dropped, the rest kept."""
    pending = v.table("events").select(F.col("user_id").alias("job"), "event_type", "event_id")
    done = v.table("events").where("event_type = 'purchase' and value > 120").select(F.col("user_id").alias("job")).distinct().withColumn("done", F.lit(True))
    ranked = pending.withColumn("rn", F.row_number().over(W.partitionBy("job", "event_type").orderBy("event_id"))).join(done, "job", "left")
    outcome = F.when(F.coalesce("done", F.lit(False)), "satisfied").when(F.col("rn") > 1, "duplicate").otherwise("kept")
    return ranked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def retries(v: Views, base_seconds: int = 10, most: int = 5) -> DataFrame:
    """event_id, attempt, action, delay: failures in a row wait base * 2^(n-1) seconds and are dead letters beyond `most`."""
    w = W.partitionBy("job").orderBy("ts", "event_id")
    o = outcomes(v).withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    o = o.where("not ok").withColumn("attempt", F.row_number().over(W.partitionBy("job", "run").orderBy("ts", "event_id")))
    dead = F.col("attempt") > most
    return o.select("event_id", "attempt", F.when(dead, "dead_letter").otherwise("retry").alias("action"), F.when(~dead, F.lit(base_seconds) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("long").alias("delay"))


def backpressure_states(depth: np.ndarray, high: int, low: int, paused: bool = False) -> np.ndarray:
    """Whether intake is paused after each depth: from `high` on, until the depth is at `low` or below."""
    mark = np.where(depth >= high, 1, np.where(depth <= low, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    return np.where(last >= 0, mark[np.maximum(last, 0)] == 1, paused)


def backpressure(v: Views, high: int = 40, low: int = 20) -> DataFrame:
    """hour, depth, paused of each event type's queue: +1 for each view, -1 for each click, by hour.

    The state is the last hour's mark that was at or beyond a water line, so a window with nulls ignored gives it.
    """
    hourly = v.table("events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum(F.when(F.col("value") > 50, 1).otherwise(-1)).alias("delta"))
    w = W.partitionBy("event_type").orderBy("hour")
    d = hourly.withColumn("depth", F.sum("delta").over(w))
    mark = F.when(F.col("depth") >= high, True).when(F.col("depth") <= low, False)
    return d.select("event_type", "hour", "depth", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)).alias("paused"))


class Breaker:
    """Opens after `failures` in a row for window * 2^(n-1) seconds, at most `longest`; then one probe decides."""

    def __init__(self, failures: int = 5, window: float = 15.0, longest: float = 600.0):
        self.limit, self.window, self.longest = failures, window, longest
        self.failed, self.opened, self.until, self.probing = 0, 0, 0.0, False

    def allow(self, now: float) -> bool:
        if self.opened == 0:
            return True
        if now >= self.until and not self.probing:
            self.probing = True
            return True
        return False

    def record(self, ok: bool, now: float) -> None:
        if ok:
            self.failed, self.opened, self.until, self.probing = 0, 0, 0.0, False
            return
        self.failed += 1
        if self.probing or (self.opened == 0 and self.failed >= self.limit):
            self.opened += 1
            self.until = now + min(self.longest, self.window * 2 ** (self.opened - 1))
        self.probing = False

    @property
    def state(self) -> str:
        return "closed" if self.opened == 0 else "half_open" if self.probing else "open"


def breaker_states(v: Views) -> DataFrame:
    """event_id, backend, allowed, state: each backend's (user's) breaker over all of its outcomes in time order.

    A breaker is serial by nature, so one backend's outcomes are one ordered group; backends are independent of each other.
    """
    rows = outcomes(v).select("event_id", F.col("job").alias("backend"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ok")

    def run(key, pdf):
        import pandas as pd

        breaker, out = Breaker(), []
        for e, at, ok in pdf.sort_values(["at", "event_id"])[["event_id", "at", "ok"]].itertuples(index=False):
            allowed = breaker.allow(at / 1e6)
            if allowed:
                breaker.record(bool(ok), at / 1e6)
            out.append((e, key[0], allowed, breaker.state))
        return pd.DataFrame(out, columns=["event_id", "backend", "allowed", "state"])

    return rows.groupBy("backend").applyInPandas(run, "event_id long, backend long, allowed boolean, state string")


def changed_since(v: Views, since: str) -> DataFrame:
    """user_id, last change of every user that changed after a time, once each; an empty time is all of them."""
    e = v.table("events")
    if since:
        e = e.where(F.col("ts") > F.lit(since).cast("timestamp_ntz"))
    return e.groupBy("user_id").agg(F.max("ts").alias("changed_at"), F.count("*").alias("changes"))


def sweep(v: Views, cursor: str = "", limit: int = 200) -> DataFrame:
    """The next chunk of a self-heal sweep: objects from the cursor on, in digest order."""
    return v.objects().where(F.col("digest") >= cursor).orderBy("digest").limit(limit).select("digest", "media_type")


def project_events(df: DataFrame) -> DataFrame:
    """The state that a batch of changes leaves: the newest event of each user and kind."""
    return best_per_key(df, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts", "value")


def ops_status(v: Views) -> DataFrame:
    """queue, depth, oldest: how much waits of each kind."""
    return v.table("events").groupBy(F.col("event_type").alias("queue")).agg(F.count("*").alias("depth"), F.min("ts").alias("oldest"))
