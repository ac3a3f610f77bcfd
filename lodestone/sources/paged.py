"""A paged mail service as a streaming source: a full listing page by page, then what the history adds.

The service here is a folder that holds a file for each page of messages, in the order in which they came; a page is named by its
number, and the last number is the history id. A stream starts with the full listing or behind a history id. Its offset is the
history id up to which pages were planned, so Spark's checkpoint is the stored cursor: pages of a batch that did not end are read
again, others never. The oldest pages may be gone; a cursor that points before them has expired and is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "page bigint, message_id string, thread_id bigint, role string, text string"


class CursorExpired(RuntimeError):
    """The history id lies before the oldest page that the service still has; a full listing is needed."""


@dataclass
class Page(InputPartition):
    number: int


class Service:
    """Pages of a folder, on whatever file system its address names."""

    def __init__(self, address: str):
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(address)

    def pages(self) -> list[int]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self.path))
        return sorted(int(f.base_name.split(".")[0].split("-")[1]) for f in found if f.base_name.startswith("page-"))

    def message_batches(self, page: int) -> Iterator:
        import pyarrow.parquet as pq
        from pyarrow import fs

        folder = f"{self.path}/page-{page:08d}.parquet"
        for f in self.files.get_file_info(fs.FileSelector(folder)):
            if f.base_name.endswith(".parquet"):
                with self.files.open_input_file(f.path) as file:
                    yield from pq.ParquetFile(file).iter_batches(columns=["message_id", "thread_id", "role", "text"])


class PagedMailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.address = options["path"]
        self.mode, self.anchor, self.limit = options.get("mode", "full"), options.get("historyanchor"), int(options.get("pagesperbatch", "0"))
        if self.mode not in ("full", "history"):
            raise ValueError(f"unsupported mode {self.mode}")
        if self.mode == "history" and self.anchor is None:
            raise ValueError("history mode needs a history anchor")
        self.planned: int | None = None

    def initialOffset(self) -> dict:
        if self.mode == "history":
            return {"mode": "history", "history": int(self.anchor)}
        pages = Service(self.address).pages()
        return {"mode": "full", "history": (pages[0] if pages else 0) - 1}

    def latestOffset(self) -> dict:
        pages = Service(self.address).pages()
        last = pages[-1] if pages else -1
        if self.limit and self.planned is not None:
            last = min(last, self.planned + self.limit)
        return {"mode": "history", "history": last}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        pages = Service(self.address).pages()
        if pages and start["history"] + 1 < pages[0]:
            raise CursorExpired(f"history cursor {start['history']} expired, the oldest page is {pages[0]}; run a full listing")
        self.planned = end["history"]
        return [Page(p) for p in pages if start["history"] < p <= end["history"]]

    def read(self, partition: Page) -> Iterator:
        import pyarrow as pa

        for b in Service(self.address).message_batches(partition.number):
            yield pa.RecordBatch.from_arrays([pa.array([partition.number] * b.num_rows, pa.int64()), *b.columns], names=["page", *b.schema.names])

    def commit(self, end: dict) -> None:
        self.planned = end["history"]


class PagedMail(DataSource):
    """Format `paged_mail`. Options: path, mode (full or history), historyAnchor, pagesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "paged_mail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PagedMailReader:
        return PagedMailReader({k.lower(): x for k, x in self.options.items()})


def publish(messages: DataFrame, address: str, first: int, per_page: int = 100) -> int:
    """Store messages (message_id, thread_id, role, text, in the order of `sent`) as pages from number `first` on; the next number.

    Pages are consecutive ranges of about per_page messages each, cut by Spark's range partitioning.
    """
    count = max(1, -(-messages.count() // per_page))
    ranged = messages.repartitionByRange(count, "sent").sortWithinPartitions("sent").withColumn("page", F.spark_partition_id() + F.lit(first))
    ranged.select("message_id", "thread_id", "role", "text", "page").write.partitionBy("page").parquet(f"{address}/incoming-{first}")
    spark, next_page = messages.sparkSession, first
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(address).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path(f"{address}/incoming-{first}")) if "=" in s.getPath().getName())
    for n in numbers:  # a rename a page
        fs.rename(path(f"{address}/incoming-{first}/page={n}"), path(f"{address}/page-{next_page:08d}.parquet"))
        next_page += 1
    fs.delete(path(f"{address}/incoming-{first}"), True)
    return next_page


def pull(spark: SparkSession, address: str, base: str, **options: str) -> DataFrame:
    """Take what the service has into a table below base, each message once; called again it goes on behind the last page taken."""
    spark.dataSource.register(PagedMail)
    reader = spark.readStream.format("paged_mail").option("path", address)
    for k, x in options.items():
        reader = reader.option(k, x)
    query = reader.load().writeStream.format("parquet").option("path", f"{base}/messages").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{base}/messages")
