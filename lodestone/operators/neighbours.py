"""Approximate nearest neighbours of all rows: overlapping cells around pivots, compared whole as matrix products, and exact ranks."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.resolve import classes
from lodestone.plans.fixpoint import written

#: Components of an identity vector, and claims whose vectors are held at once.
DIMS, PIECE = 128, 8192
#: Rows a pivot stands for, pivots at most, and cells that each row is put in.
AIM, PIVOTS, CELLS = 128, 16_384, 12
#: Rows of a cell that are compared in one group; a larger cell is compared by pairs of blocks. Rows that are ranked at once.
MOST, CHUNK = 4096, 512
#: Neighbours under this cosine are none.
FLOOR = 0.2


def identity_classes(weighted: DataFrame) -> DataFrame:
    """entity, claims, class, n: entities with equal claims (attr, value, omega) are a class, so they have one vector."""
    return classes(weighted.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("attr", "value", "omega"))).alias("claims")))


def identity_vectors(weighted: DataFrame, dims: int = DIMS) -> DataFrame:
    """entity and vec, the unit vector of its claims (entity, attr, value, omega): signed hashes of the trigrams of each claim, which
    has its weight as length. Records that share claims, or spell them alike, lie close."""
    return vectors_of(weighted.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("attr", "value", "omega"))).alias("claims")), dims)


def vectors_of(sets: DataFrame, dims: int = DIMS) -> DataFrame:
    """The same of sets of claims (entity, claims)."""

    def hashed(x):
        text = F.concat_ws(":", x["attr"], x["value"])
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.xxhash64(F.substring(text, i, F.lit(3))))
        return F.struct(x["omega"].alias("omega"), grams.alias("grams"))

    def build(batches):
        for b in batches:
            claims = b.column(1).flatten()
            row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            out = np.zeros((b.num_rows, dims))
            for s in range(0, len(claims), PIECE):
                part = claims.slice(s, PIECE)
                omega, grams = part.flatten()  # of this slice only
                h = grams.flatten().to_numpy().view(np.uint64)
                at = np.repeat(np.arange(len(part)), grams.value_lengths().to_numpy()) * dims + (h % np.uint64(dims)).astype(np.int64)
                one = np.bincount(at, np.where(h >> np.uint64(63), -1.0, 1.0), len(part) * dims).reshape(-1, dims)
                one *= (omega.to_numpy() / np.maximum(1e-9, np.linalg.norm(one, axis=1)))[:, None]
                of = row[s : s + PIECE]
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                out[of[first]] += np.add.reduceat(one, first)
            out = (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dims), pa.array(out.ravel()))], names=["entity", "vec"])

    return sets.select("entity", F.transform("claims", hashed).alias("claims")).mapInArrow(build, "entity string, vec array<float>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def numbered(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rep, id, vec: entities (entity, vec) with equal vectors as one row, named by the smallest and numbered in the order of names; and
    entity, rep of all."""
    held = written(vectors.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}), "identity")
    of = written(held.select("entity", "h1", "h2").join(held.groupBy("h1", "h2").agg(F.min("entity").alias("rep")), ["h1", "h2"]).select("entity", "rep"), "identity-classes")
    kept = held.join(of.where("entity = rep"), "entity").select("rep", "vec")
    return written(kept.orderBy("rep").withColumn("id", F.monotonically_increasing_id()), "identity-numbered"), of


def cells(reps: DataFrame, aim: int = AIM, most: int = CELLS) -> DataFrame:
    """id, cells, vec: for each row the `most` cells whose pivots are nearest to it, both seen from the middle of the pivots.

    The pivots are rows by hash, one in `aim` and about PIVOTS at most; where every row would be in most cells there is one cell of all.
    """
    n, whole = reps.count(), reps.select("id", F.array(F.lit(0)).alias("cells"), "vec")
    if n <= aim * most:
        return whole
    wanted = min(PIVOTS, n // aim)
    pivots = reps.where(F.pmod(F.xxhash64("rep"), F.lit(n)) < wanted).select("vec").collect()
    if len(pivots) <= most:
        return whole
    p = np.array([r.vec for r in pivots], np.float32)
    middle = p.mean(0)
    p = p - middle
    p /= np.maximum(1e-9, np.linalg.norm(p, axis=1, keepdims=True))

    def deal(batches):
        for b in batches:
            for s in range(0, b.num_rows, CHUNK):
                part = b.slice(s, CHUNK)
                side = (_rows(part.column(1)) - middle) @ p.T
                near = np.argpartition(-side, most - 1, axis=1)[:, :most].astype(np.int32)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * most)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(near.ravel())), part.column(1)], names=["id", "cells", "vec"])

    return reps.select("id", "vec").mapInArrow(deal, "id bigint, cells array<int>, vec array<float>")


def blocks(dealt: DataFrame, most: int = MOST) -> DataFrame:
    """group, block, id, vec: the groups to compare. A cell of up to `most` rows is one, of one block; of a larger one every two blocks
    of about `most` rows are a group, so all its pairs meet and no task holds it whole."""
    sizes = dealt.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("c")).withColumn("parts", F.ceil(F.col("c") / F.lit(most)).cast("int")).select("cell", "parts")
    mine = dealt.select("id", F.explode("cells").alias("cell"), "vec").join(F.broadcast(written(sizes, "cell-blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row a pivot
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("group"), (F.col("block") * 2 + (F.col("block") == F.col("other")).cast("int")).alias("block"), "id", "vec")


def grouped(batches, key: int = 0):
    """Batches of whole groups, of rows that come sorted by a key column."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            t = pa.Table.from_batches([b])
            held = t if held is None or not held.num_rows else pa.concat_tables([held, t])
        if held is None or not held.num_rows:
            continue
        keys = held.column(key).to_numpy()
        end = len(keys) if b is None else int(np.searchsorted(keys, keys[-1]))
        if end:
            yield held.slice(0, end).combine_chunks()
        held = held.slice(end).combine_chunks()


def best(a: np.ndarray, b: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (a, b) that are among the k of a with the highest cosine (at 6 digits), then the smallest b; sorted by a and rank."""
    cos = np.round(cos.astype(np.float64), 6)
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    ok = rank < k
    return a[ok], b[ok], cos[ok]


def compared(x: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int, floor: float):
    """Pieces of pairs of one group, k at most of each row. Rows of two different blocks meet across; those of one meet each other."""
    cross = len(block) and not (block & 1).any()
    for s in range(0, len(x), CHUNK):
        cos = x[s : s + CHUNK] @ x.T
        cos[np.arange(len(cos)), s + np.arange(len(cos))] = -2
        if cross:
            cos[block[s : s + CHUNK, None] == block[None]] = -2
        least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k] - 1e-6 if cos.shape[1] > k else np.full(len(cos), floor)
        i, j = np.nonzero(cos >= np.maximum(least, floor - 1e-6)[:, None])
        a, b, c = best(ids[s + i], ids[j], cos[i, j], k)
        yield a[c >= floor], b[c >= floor], c[c >= floor]


def search(reps: DataFrame, k: int, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """a, b, cosine: up to k neighbours b of every row a (rep, id, vec), by numbers, of those that share a cell and reach the floor."""

    def lists(a, b, c):
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        ends = pa.array(np.append(first, len(a)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.ListArray.from_arrays(ends, pa.array(b)), pa.ListArray.from_arrays(ends, pa.array(c.astype(np.float32)))], names=["a", "b", "cosine"])

    def compare(batches):
        for t in grouped(batches):
            group, block, ids = (t.column(n).to_numpy() for n in ("group", "block", "id"))
            x = _rows(t.column("vec").chunk(0))
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for s, e in zip(edge, edge[1:]):
                for a, b, c in compared(x[s:e], ids[s:e], block[s:e], k, floor):
                    if len(a):
                        yield lists(a, b, c)

    def merge(batches):
        for t in grouped(batches):
            b = t.column("b").chunk(0)
            a, b, c = np.repeat(t.column("a").to_numpy(), b.value_lengths().to_numpy()), b.flatten().to_numpy(), t.column("cosine").chunk(0).flatten().to_numpy()
            order = np.lexsort((-c, b, a))  # a pair that met in several cells
            a, b, c = a[order], b[order], c[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            a, b, c = best(a[new], b[new], c[new], k)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["a", "b", "cosine"])

    met = blocks(written(cells(reps), "cells-dealt"), most)
    found = met.repartition("group").sortWithinPartitions("group", "id").mapInArrow(compare, "a bigint, b array<bigint>, cosine array<float>")
    return found.repartition("a").sortWithinPartitions("a").mapInArrow(merge, "a bigint, b bigint, cosine double")


def named(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) by the names of their rows."""
    for end in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("id").alias(end), F.col("rep").alias("_name")), end).withColumn(end, F.col("_name")).drop("_name")
    return pairs.select("a", "b", *[c for c in pairs.columns if c not in ("a", "b")])


def nearest(vectors: DataFrame, k: int, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """a, b, cosine: up to k neighbours b of every entity a, by cosine and then name, of those that share a cell and reach the floor.

    Rows (entity, vec) are compared in cells only. Entities with equal vectors are one row of the search, named by the smallest, which
    each of the others has as its neighbour: a crowd of them is no crowd of pairs. Recall against all pairs is tested. An empty table
    gives an empty one.
    """
    reps, of = numbered(vectors)
    same = of.where("entity != rep").select(F.col("entity").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine"))
    return named(search(reps, k, floor, most), reps).unionByName(same)


def near_pairs(classes_: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b): pairs of vectors, one of which is among the k nearest of the other, by the smallest entity of each; and entity, rep of
    all entities of classes (entity, claims, class) of equal claims."""
    reps, of = numbered(vectors_of(classes_.where("entity = class")))
    found = search(reps, k).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    members = classes_.select("entity", "class").join(of.withColumnRenamed("entity", "class"), "class").select("entity", "rep")
    return named(found, reps), members
