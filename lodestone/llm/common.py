"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of the words and line keys of this subpackage: space and 0x09-0x0D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and all runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Lists that this thread's new paths are noted in.
_open = threading.local()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    for made in getattr(_open, "lists", ()):
        made.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended before; the cluster then clears its own folder
        pass


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner true sizes."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, label: str, step: Callable[[], DataFrame]) -> DataFrame:
    """What step gives, written by `cut`; then the files of all that step wrote on the way are removed."""
    made: list[str] = []
    _open.lists = [*getattr(_open, "lists", ()), made]
    try:
        df = step()
    finally:
        _open.lists = _open.lists[:-1]
    out = cut(df, label)
    for path in made:
        _remove(spark, path)
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a table that `cut` wrote and nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lodestone-" in folder:
            _remove(df.sparkSession, folder)


def lowered(column):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def fold(doc_id):
    """crc32 of the id as text, modulo 5; 0 is the held-out fold. A null id is in no training fold."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("0")).cast("binary")), F.lit(5))


def first_by_hash(df: DataFrame, label: str, key: str, most: int, salts: int = 64) -> DataFrame:
    """The `most` rows of each label that come first by the hash of their key, with their `rank`.

    Ranks are taken within salted parts of a label and then among what those kept, so that no task sees more of a label than
    a part of it or salts * most rows.
    """
    h = df.withColumn("_h", F.xxhash64(key))
    part = W.partitionBy(label, F.pmod(F.col("_h"), F.lit(salts))).orderBy("_h", key)
    kept = h.withColumn("_p", F.row_number().over(part)).where(F.col("_p") <= most).drop("_p")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy("_h", key))).where(F.col("rank") <= most).drop("_h")


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches of some megabytes, so that neither the executor's nor the worker's memory grows with the length of the rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return a worker's freed memory to the machine: workers live on between tasks, and an executor's memory is theirs and its JVM's together."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another libc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the given text column holds about most_bytes at most in each piece (a longer single row stays whole)."""
    for batch in batches:
        array = batch.column(column)
        lengths = np.diff(_offsets(array)) if len(array) else np.zeros(0, np.int64)
        group = np.cumsum(lengths) // most_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1 if len(group) else []
        start = 0
        for end in [*cuts, batch.num_rows]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)


def joined_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array end to end and len+1 offsets; a null is empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = _offsets(array)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def running_totals(df: DataFrame, order: list[str], values: list[str], label: str) -> DataFrame:
    """Global exclusive running sums of the value columns in the given order, and the global row number from 0 as `idx`.

    One range shuffle; each task sums its own range, and the offsets come from one small row per range. No group meets in
    one task, so a key that holds a third of all rows is no hot spot. Order columns must place equal keys apart (add a hash).
    """
    spark = df.sparkSession
    schema = df.select(*order, *[c for c in df.columns if c not in order]).schema
    names = [f.name for f in schema]
    ranged = df.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", `part` int, `idx` bigint, " + ", ".join(f"`{v}_before` {df.schema[v].dataType.simpleString()}" for v in values)

    def add(batches):
        from pyspark import TaskContext

        part, row, sums = TaskContext.get().partitionId(), 0, dict.fromkeys(values, 0)
        for b in batches:
            n = b.num_rows
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int64))]
            for v in values:
                x = b.column(names.index(v)).to_numpy(zero_copy_only=False)
                total = np.cumsum(x)
                more.append(pa.array(total - x + sums[v]))
                sums[v] = sums[v] + total[-1] if n else sums[v]
            row += n
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, "part", "idx", *[f"{v}_before" for v in values]])

    parts = cut(map_arrow(ranged, add, out.rstrip(", ")), label)
    totals = parts.groupBy("part").agg(F.count("*").alias("n"), *[F.max(F.col(f"{v}_before") + F.col(v)).alias(v) for v in values]).orderBy("part").collect()
    rows, carried = [], [0] + [0] * len(values)
    for t in totals:
        rows.append((t["part"], *carried))
        carried = [c + t[k] for c, k in zip(carried, ["n", *values])]
    types = ["bigint", *[df.schema[v].dataType.simpleString() for v in values]]
    head = "part int, " + ", ".join(f"_o{i} {t}" for i, t in enumerate(types))
    rows = [(r[0], *[float(x) if t == "double" else int(x) for x, t in zip(r[1:], types)]) for r in rows]
    offsets = F.broadcast(spark.createDataFrame(rows, head))  # one row per range partition
    joined = parts.join(offsets, "part")
    return joined.select(*names, (F.col("idx") + F.col("_o0")).alias("idx"), *[(F.col(f"{v}_before") + F.col(f"_o{i + 1}")).alias(f"{v}_before") for i, v in enumerate(values)])
