"""Building blocks of the read queries: paging, top one of a key, sorted sets, text search."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.plans.stored import parsed


def norm_limit(limit: int | None, default: int = 50, most: int = 1000) -> int:
    """A limit of none or less is the default; a larger one than `most` is `most`."""
    return default if not limit or limit <= 0 else min(limit, most)


def paged(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, total: bool = True) -> DataFrame:
    """One page in the given total order, with the number of all rows as total_count.

    The count is an aggregate of its own (partial counts, one row), not a window over everything in one task; the page is a
    top-k that sorts no more than limit + offset rows of each partition.
    """
    page = df.orderBy(*order).offset(max(0, offset)).limit(norm_limit(limit))
    if not total:
        return page
    count = df.agg(F.count("*").alias("total_count"))
    return page.crossJoin(F.broadcast(count))  # one row


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the order must be total. Plans with a group limit below the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def sorted_set(column: str | Column, when: Column | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.array_sort(F.collect_set(c if when is None else F.when(when, c)))


def exists(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def web_search(text: Column, query: str) -> Column:
    """A predicate for a web-style query: words are all needed, "a b" is a phrase, `or` parts alternatives, -x excludes.

    Words are lower-cased runs of letters and digits, without stemming or stop words. A query without words matches nothing.
    """
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    hit = lambda excluded, words: ~F.contains(padded, F.lit(f" {' '.join(words)} ")) if excluded else F.contains(padded, F.lit(f" {' '.join(words)} "))
    found = [reduce(lambda a, b: a & b, [hit(*part) for part in parts]) for parts in parsed(query)]
    return reduce(lambda a, b: a | b, found) if found else F.lit(False)


def in_pieces(batches: Iterable[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces whose text column holds about `most` bytes (a longer row stays whole)."""
    for b in batches:
        group = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(column)), 0).cast("int64")).to_numpy() // most
        cuts = [i for i in range(1, b.num_rows) if group[i] != group[i - 1]]
        for start, end in zip([0, *cuts], [*cuts, b.num_rows]):
            if end > start:
                yield b.slice(start, end - start)


def map_texts(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow over (key, text) in small pieces, so that a worker's memory grows neither with the rows of a task nor with their length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

    def run(batches):
        yield from function(in_pieces(batches, 1))
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)
