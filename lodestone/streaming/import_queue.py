"""An import queue that survives its runs: items, leases and outcomes as a log of small batches, from which any later run goes on.

Every change is a folder of rows under the next number: items that were found, items that a worker leased until a time, outcomes. The
state of an item is its last row, so nothing is rewritten, and a run that stops anywhere leaves a state that the next one reads: items
it had leased come free when the lease ends, and outcomes that it did not write down don't count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.common import best_per_key
from lodestone.plans.fixpoint import written

SCHEMA = "item string, ord bigint, status string, worker string, until bigint, attempts int, outcome string"
OPEN = ("queued", "failed")


@dataclass
class Queue:
    """The queue below a folder; `most` attempts of an item end as dead."""

    spark: SparkSession
    base: str
    most: int = 3

    def _folders(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs, log = path(self.base).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path(f"{self.base}/log")
        if not fs.exists(log):
            return []
        names = {s.getPath().getName(): s.getPath() for s in fs.listStatus(log)}
        return sorted(int(n.split("=")[1]) for n, p in names.items() if n.startswith("seq=") and fs.exists(path(p, "_SUCCESS")))

    def _append(self, rows: DataFrame) -> None:
        number = max(self._folders(), default=-1) + 1
        rows.select("item", "ord", "status", "worker", "until", "attempts", "outcome").write.mode("overwrite").parquet(f"{self.base}/log/seq={number:08d}")

    def state(self) -> DataFrame:
        """The last row of each item."""
        numbers = self._folders()
        if not numbers:
            return self.spark.createDataFrame([], SCHEMA)
        log = self.spark.read.schema(f"{SCHEMA}, seq bigint").option("basePath", f"{self.base}/log").parquet(*[f"{self.base}/log/seq={n:08d}" for n in numbers])
        return best_per_key(log, ["item"], [F.desc("seq")]).drop("seq")

    def discover(self, items: DataFrame) -> None:
        """Queue items (item, ord) that are not known yet; found twice, they are queued once."""
        fresh = best_per_key(items.select("item", F.col("ord").cast("bigint").alias("ord")), ["item"], [F.asc("ord")]).join(self.state().select("item"), "item", "left_anti")
        self._append(fresh.select("item", "ord", F.lit("queued").alias("status"), F.lit("").alias("worker"), F.lit(0).cast("bigint").alias("until"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("outcome")))

    def lease(self, worker: str, now: int, seconds: int, n: int) -> DataFrame:
        """The next n items that wait or whose lease has ended, now this worker's until now + seconds."""
        free = self.state().where(F.col("status").isin(*OPEN) | ((F.col("status") == "leased") & (F.col("until") <= now)))
        taken = free.orderBy("ord", "item").limit(n).withColumns({"status": F.lit("leased"), "worker": F.lit(worker), "until": F.lit(now + seconds).cast("bigint")})
        taken = written(taken, "leased")
        self._append(taken)
        return taken

    def finish(self, taken: DataFrame, outcomes: DataFrame) -> None:
        """Write down the outcomes (item, outcome; null: it failed) of leased items."""
        done = taken.drop("outcome").join(outcomes.select("item", "outcome"), "item", "left").withColumn("attempts", F.col("attempts") + 1)
        status = F.when(F.col("outcome").isNotNull(), "done").when(F.col("attempts") >= self.most, "dead").otherwise("failed")
        self._append(done.withColumns({"status": status, "until": F.lit(0).cast("bigint")}))

    def run(self, process: Callable[[DataFrame], DataFrame], worker: str = "import", now: Callable[[], int] = lambda: 0, seconds: int = 600, batch: int = 1000) -> DataFrame:
        """Lease, process and finish until nothing is free; the state that is left. process takes leased items and gives (item, outcome).

        An error of process ends the run: what it had leased waits for the lease's end.
        """
        while True:
            taken = self.lease(worker, now(), seconds, batch)
            if not taken.limit(1).count():
                return self.state()
            self.finish(taken, written(process(taken), "outcomes"))

    def report(self) -> dict[str, int]:
        return {r.status: r["count"] for r in self.state().groupBy("status").count().collect()}  # a row a status
