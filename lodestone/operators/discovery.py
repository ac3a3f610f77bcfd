"""Category discovery: TF-IDF of one- and two-word terms, exact cosines by blocks, density clusters, and their terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.neighbours import grouped
from lodestone.plans.fixpoint import written
from lodestone.plans.labels import smallest_reachable

#: Share of documents beyond which a term says nothing, terms kept, and the clusters' cosine distance.
MOST_SHARE, FEATURES, EPS = 0.85, 5000, 0.55
#: Vectors of a group that a task compares with another group at most, groups to have before they grow, and the least of one for that.
GROUP, SPREAD, FEW = 32_768, 8, 1024
#: Vectors of a block and of those that it meets at once; most frequent terms that are compared as dense columns; what single floats may err.
BLOCK, TILE, HEAD, ERR = 256, 1024, 64, 1e-5


def tfidf(docs: DataFrame, features: int = FEATURES, most_share: float = MOST_SHARE) -> DataFrame:
    """id, term, df, w: unit vectors of docs (id, text) over the most frequent terms; idf is ln((1 + n) / (1 + df)) + 1."""
    words = docs.select("id", F.filter(tokens("text"), lambda x: F.length(x) >= 3).alias("t"))
    pairs = F.filter(F.zip_with("t", F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    counts = words.select("id", F.explode(F.concat("t", pairs)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    counts = written(counts, "terms")
    n = docs.select("id").distinct().count()
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") <= most_share * n).orderBy(F.desc("total"), "term").limit(features)
    raw = counts.join(F.broadcast(stats), "term").withColumn("x", F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))  # `features` rows
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return written(raw.join(norm, "id").select("id", "term", "df", (F.col("x") / F.col("norm")).alias("w")), "tfidf")


def cosine_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """a, b, cosine of all pairs with a < b and cosine >= least.

    Terms are ordered by rarity; a vector's prefix ends where the rest is shorter than `least`. Two vectors that reach it share a
    term of both prefixes, so only prefixes are joined, and candidates are then measured in full.
    """
    tail = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id").orderBy(F.desc("df"), F.desc("term"))))
    prefix = vectors.withColumn("tail", tail).where(F.col("tail") >= least - 1e-9).select("term", "id")
    met = prefix.select("term", F.col("id").alias("a")).join(prefix.select("term", F.col("id").alias("b")), "term").where("a < b").select("a", "b").distinct()
    dot = met.join(vectors.select(F.col("id").alias("a"), "term", F.col("w").alias("wa")), "a").join(vectors.select(F.col("id").alias("b"), "term", F.col("w").alias("wb")), ["b", "term"])
    return dot.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least)


def eps_forest(vectors: DataFrame, least: float) -> DataFrame:
    """a, b: pairs with cosine >= least whose connected components are those of all such pairs.

    Ids are dealt to groups, and every two of these (and each with itself) are a task, which gives out at most one link a row. Every two
    vectors are compared: frequent terms as a product of dense columns, the others by their postings, so only where two share one.
    """
    terms = [r.term for r in vectors.select("term", "df").distinct().orderBy(F.desc("df"), "term").collect()]  # the features: a bounded number
    place = vectors.sparkSession.createDataFrame([(x, i) for i, x in enumerate(terms)] or [("", 0)], "term string, col int")
    rows = vectors.join(F.broadcast(place), "term").groupBy("id").agg(F.collect_list("col").alias("cols"), F.collect_list(F.col("w").cast("double")).alias("ws"))
    rows = written(rows, "eps-rows")
    n = rows.count()
    groups = max(1, -(-n // GROUP), min(SPREAD, -(-n // FEW)))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    low, high = F.least("g", "h"), F.greatest("g", "h")
    tasks = dealt.select((high * (high + 1) / 2 + low).cast("int").alias("task"), (F.col("g") != low).cast("int").alias("side"), "id", "cols", "ws")
    dealt_out = tasks.repartitionById(groups * (groups + 1) // 2, "task").sortWithinPartitions("task", "side")
    return written(dealt_out.mapInArrow(_compare(len(terms), least), "a string, b string"), "eps-near")  # a later step reads it twice


class _Side:
    """Vectors of one side of a task: dense columns of the HEAD most frequent terms, and the entries of the others by rows."""

    def __init__(self, cols: pa.Array, ws: pa.Array):
        self.n, size = len(cols), cols.value_lengths().to_numpy()
        self.ends = np.append(0, np.cumsum(size))
        self.col, self.w = cols.flatten().to_numpy(), ws.flatten().to_numpy()
        row, head = np.repeat(np.arange(self.n), size), self.col < HEAD
        self.head = np.zeros((self.n, HEAD), np.float32)
        self.head[row[head], self.col[head]] = self.w[head]
        self.row, self.tail, self.tail_w = row[~head], self.col[~head], self.w[~head].astype(np.float32)

    def rows(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.row, (s, e))
        return self.row[a:b] - s, self.tail[a:b], self.tail_w[a:b]

    def postings(self, s: int, e: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each term's postings begin, and their rows and weights, of rows s to e."""
        row, term, w = self.rows(s, e)
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(width + 1)), row[order], w[order]

    def vector(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.col[self.ends[i] : self.ends[i + 1]], self.w[self.ends[i] : self.ends[i + 1]]


def _dot(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    return float(x[1][i] @ y[1][j])


def _near(left: _Side, right: _Side, width: int, least: float, same: bool):
    """Pieces (i, j) of the rows whose cosine is at least `least`."""
    tiles = [(s, min(s + TILE, right.n)) for s in range(0, right.n, TILE)]
    tiles = [(s, e, right.postings(s, e, width)) for s, e in tiles]
    for s in range(0, left.n, BLOCK):
        e = min(s + BLOCK, left.n)
        row, term, w = left.rows(s, e)
        for from_, to, (begin, rows, ws) in tiles:
            if same and to <= s:
                continue
            cos = (left.head[s:e] @ right.head[from_:to].T).ravel()
            size = begin[term + 1] - begin[term]
            at = np.repeat(begin[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            np.add.at(cos, np.repeat(row * (to - from_), size) + rows[at], np.repeat(w, size) * ws[at])
            hit = np.flatnonzero(cos >= least - ERR)
            i, j = s + hit // (to - from_), from_ + hit % (to - from_)
            keep = cos[hit] > least + ERR
            for k in np.flatnonzero(~keep):
                keep[k] = _dot(left.vector(i[k]), right.vector(j[k])) >= least
            yield i[keep], j[keep]


def _compare(width: int, least: float):
    """A function of batches of rows (task, side, id, cols, ws) sorted by task and side that gives links between rows of a task."""

    def run(batches):
        for t in grouped(batches):
            first = int(np.searchsorted(t.column("side").to_numpy(), 1))
            cols, ws, ids = (t.column(x).chunk(0) for x in ("cols", "ws", "id"))
            same = first in (0, len(ids))
            left = _Side(cols, ws) if same else _Side(cols.slice(0, first), ws.slice(0, first))
            right, shift = (left, 0) if same else (_Side(cols.slice(first), ws.slice(first)), first)
            root = np.arange(len(ids))
            for i, j in _near(left, right, width, least, same):
                j = j + shift
                while True:
                    apart = root[i] != root[j]
                    if not apart.any():
                        break
                    i, j = i[apart], j[apart]
                    np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
                    while (root[root] != root).any():
                        root = root[root]
            other = np.flatnonzero(root != np.arange(len(ids)))  # short ways: each to the first
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(root[other])), ids.take(pa.array(other))], names=["a", "b"])

    return run


def discover(docs: DataFrame, eps: float = EPS, terms: int = 5) -> DataFrame:
    """cluster, size, terms: clusters of at least two documents (with two as the density, clusters are components of the eps graph).

    Documents of equal texts are joined to the first of them, which alone is compared with others.
    """
    v = tfidf(docs)
    same = docs.select("id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    named = written(same.join(same.groupBy("h").agg(F.min("id").alias("first")), "h").select("id", "first"), "same")
    copies = named.where("id <> first").join(v.select("id").distinct(), "id", "left_semi").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = eps_forest(v.join(named.where("id = first").select("id"), "id", "left_semi").withColumn("id", F.col("id").cast("string")), 1 - eps)
    edges = near.unionByName(copies.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    label = smallest_reachable(edges)
    placed = v.withColumn("id", F.col("id").cast("string")).join(label, "id")
    sizes = label.groupBy("component").agg(F.count("*").alias("size"))
    mean = placed.groupBy("component", "term").agg(F.sum("w").alias("w"))
    ranked = mean.withColumn("rn", F.row_number().over(W.partitionBy("component").orderBy(F.desc(F.round("w", 9)), "term"))).where(F.col("rn") <= terms)
    named = ranked.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    return sizes.join(named, "component").select(F.col("component").alias("cluster"), "size", "terms")
