"""Vector code compression by filtering Lloyd: every partition keeps kd-trees over its parts, and whole subtrees are assigned at once.

Vectors are cut into parts, and each part position has a codebook of its own. A block of rows is stored with one kd-tree a position:
bounding boxes, sums and counts of all its nodes. In a round each node carries the entries that can still be nearest to a point of
its box. When one is left, the node's sum and count go to it whole; at the leaves the few that are left are compared point by point.
Only sums and counts of entries leave a task. All arithmetic is in integers, so results don't depend on how rows are partitioned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, map_arrow, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points of a leaf at most, and numbers of a block's part at most.
LEAF, BLOCK_NUMBERS = 8, 1 << 16
#: Scaled components below this keep every squared distance of up to 2,048 components inside 64 bits.
LARGEST = 1 << 24


@dataclass
class Tree:
    """A kd-tree over points: a perfect binary tree whose nodes halve their points, so sizes follow from the count of points alone.

    order: the points' rows in the tree's order; low, high, total: boxes and sums of the nodes, level after level from the root.
    """

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @staticmethod
    def edges(n: int) -> list[np.ndarray]:
        """The bounds of the nodes of each level in the order of the points."""
        levels = [np.array([0, n])]
        while np.diff(levels[-1]).max() > LEAF:
            e = levels[-1]
            levels.append(np.sort(np.concatenate([e, e[:-1] + np.diff(e) // 2])))
        return levels

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        """Nodes are halved along the widest side of their boxes."""
        n, levels = len(points), cls.edges(len(points))
        order = np.arange(n)
        for e in levels[:-1]:
            p = points[order]
            wide = (np.maximum.reduceat(p, e[:-1]) - np.minimum.reduceat(p, e[:-1])).argmax(1)
            node = np.repeat(np.arange(len(wide)), np.diff(e))
            order = order[np.lexsort((p[np.arange(n), wide[node]], node))]
        p = points[order]
        low, high, total = (np.concatenate([f.reduceat(p, e[:-1]) for e in levels]) for f in (np.minimum, np.maximum, np.add))
        return cls(p, order.astype(np.int32), low, high, total)

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each point in the tree's order, sums of each entry's points, counts): the nearest entry, ties to the lower one."""
        n, k = len(self.points), len(book)
        nearest, sums, counts = np.zeros(n, np.int64), np.zeros(book.shape, np.int64), np.zeros(k, np.int64)
        node, entry = np.zeros(k, np.int64), np.arange(k)  # the entries that are left at each node, by node and entry
        levels, before = self.edges(n), 0
        for depth, e in enumerate(levels):
            if not len(node):
                break
            low, high, total = (x[before : before + len(e) - 1] for x in (self.low, self.high, self.total))
            before += len(e) - 1
            node, entry = self._filter(book, low, high, node, entry)
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            alone = np.zeros(len(node), bool)
            alone[first[np.diff(np.append(first, len(node))) == 1]] = True
            whole, winner = node[alone], entry[alone]
            np.add.at(sums, winner, total[whole])
            np.add.at(counts, winner, np.diff(e)[whole])
            size = np.diff(e)[whole]
            at = np.repeat(e[whole] - np.cumsum(size) + size, size) + np.arange(size.sum())
            nearest[at] = np.repeat(winner, size)
            node, entry = node[~alone], entry[~alone]
            if depth < len(levels) - 1:
                node, entry = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([entry, entry])
                order = np.argsort(node, kind="stable")
                node, entry = node[order], entry[order]
        if len(node):
            self._leaves(book, levels[-1], node, entry, nearest, sums, counts)
        return nearest, sums, counts

    @staticmethod
    def _filter(book, low, high, node, entry):
        """The pairs without entries that are farther from all of a node's box than the one nearest to its middle."""
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(first, len(node)))
        z, lo, hi = book[entry], low[node], high[node]
        middle = 2 * z - lo - hi
        middle = np.einsum("ij,ij->i", middle, middle)
        least = np.flatnonzero(middle == np.repeat(np.minimum.reduceat(middle, first), size))
        _, one = np.unique(node[least], return_index=True)
        star = np.repeat(entry[least[one]], size)
        best = book[star]
        # the difference of the squared distances is least at the corner of the box on the entry's side
        corner = np.where(z > best, hi, lo)
        farther = np.einsum("ij,ij->i", z - best, z + best - 2 * corner)
        keep = (farther < 0) | ((farther == 0) & (entry <= star))
        return node[keep], entry[keep]

    def _leaves(self, book, edges, node, entry, nearest, sums, counts):
        size = np.diff(edges)[node]
        z = book[entry]
        for j in range(LEAF):
            there = size > j
            own, e = node[there], entry[there]
            if not len(own):
                break
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            point = edges[own] + j
            apart = self.points[point] - z[there]
            apart = np.einsum("ij,ij->i", apart, apart)
            least = np.flatnonzero(apart == np.repeat(np.minimum.reduceat(apart, first), np.diff(np.append(first, len(own)))))
            _, one = np.unique(own[least], return_index=True)
            at, winner = point[least[one]], e[least[one]]
            nearest[at] = winner
            np.add.at(sums, winner, self.points[at])
            np.add.at(counts, winner, 1)


def scaled(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite components."""
    out = np.floor(rows.astype(np.float64) * SCALE)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a component of {LARGEST // SCALE} or more in absolute value can't be coded")
    return out.astype(np.int64)


def finite(vectors: DataFrame) -> DataFrame:
    """The rows whose vector is not null and holds neither null nor non-finite components."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & ~odd)


def forest(kept: DataFrame, size: int, parts: int = PARTS) -> DataFrame:
    """Blocks of rows with their trees, written once: vec_id and label as lists, and for each part position the tree's arrays."""
    d = size // parts
    most = max(1, BLOCK_NUMBERS // max(1, d))
    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    arrays = ("points", "ordered", "low", "high", "total")

    def blocks(batches):
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                lists = part.column(1)
                if any(n != size for n in lists.value_lengths().to_pylist()):
                    raise ValueError(f"every vector must have {size} components")
                x = scaled(lists.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size))
                trees = [Tree.build(np.ascontiguousarray(x[:, k * d : k * d + d])) for k in range(parts)]
                packed = [[t.points.astype(np.int32), t.order, t.low.astype(np.int32), t.high.astype(np.int32), t.total] for t in trees]
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(one, part.column(0)), pa.ListArray.from_arrays(one, part.column(2)), *[pa.array([[t[i].tobytes() for t in packed]], pa.list_(pa.binary())) for i in range(5)]],
                    names=["vec_ids", "labels", *arrays],
                )

    return cut(map_arrow(kept.select("vec_id", "embedding", "label"), blocks, f"vec_ids array<{ids}>, labels array<{labels}>, " + ", ".join(f"{a} array<binary>" for a in arrays)), "code-forest")


def _trees(batch: pa.RecordBatch, columns: int, d: int):
    """For each row of a batch with the five arrays from the given column on: its trees."""
    kinds = (np.int32, np.int32, np.int32, np.int32, np.int64)
    for r in range(batch.num_rows):
        packed = [[np.frombuffer(x.as_buffer(), kind) for x in batch.column(columns + i)[r].values] for i, kind in enumerate(kinds)]
        yield [Tree(p.reshape(-1, d).astype(np.int64), o, low.reshape(-1, d).astype(np.int64), high.reshape(-1, d).astype(np.int64), total.reshape(-1, d)) for p, o, low, high, total in zip(*packed)]


def refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, components) after one round: floors of the means; unused entries stay."""
    parts, entries, d = books.shape

    def gather(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for trees in _trees(b, 0, d):
                for k, tree in enumerate(trees):
                    _, s, c = tree.assign(books[k])
                    sums[k] += s
                    counts[k] += c
        part, entry = np.nonzero(counts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * d), pa.array(sums[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), flat], names=["part", "entry", "n", "sums"])

    found = map_arrow(blocks.select("points", "ordered", "low", "high", "total"), gather, "part int, entry int, n bigint, sums array<bigint>")
    means = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(d)]).alias("sums"))
    out = books.copy()
    for r in means.collect():  # as many rows as the codebooks have entries at most
        out[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return out


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances to the entries, summed over the parts) of every row."""
    parts, entries, d = books.shape
    schema = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema if f.name in ("vec_ids", "labels")}
    hex_of = np.array([f"{i:02x}" for i in range(entries)])

    def code(batches):
        for b in batches:
            for r, trees in enumerate(_trees(b, 2, d)):
                ids, labels = b.column(0)[r].values, b.column(1)[r].values
                codes, error = np.zeros((len(ids), parts), np.int64), np.zeros(len(ids), np.int64)
                for k, tree in enumerate(trees):
                    nearest, _, _ = tree.assign(books[k])
                    apart = tree.points - books[k][nearest]
                    codes[tree.order, k] = nearest
                    error[tree.order] += np.einsum("ij,ij->i", apart, apart)
                text = ["".join(row) for row in hex_of[codes].tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return map_arrow(blocks.select("vec_ids", "labels", "points", "ordered", "low", "high", "total"), code, f"vec_id {schema['vec_ids']}, label {schema['labels']}, code string, error bigint")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error for every row of vectors (vec_id, embedding, label) that is kept; the codebooks).

    Rows with a null vector, or null or non-finite components, are dropped. Components x become floor(1024 * x). The codebooks start
    as the parts of the `entries` (256 at most) smallest vec_ids; equal ids go by their vectors, null ids come last. Each row counts,
    repeated ones too; fewer rows than entries make smaller codebooks. All vectors must have one length, a multiple of `parts`, and
    components under 16,384 in absolute value; others raise an error. Null labels are labels. An empty table gives an empty one
    and codebooks without entries. Other columns are ignored. What the driver holds are the codebooks.
    """
    kept = finite(vectors)
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    size = len(start[0][0]) if start else 0
    if size % parts or any(len(r[0]) != size for r in start):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    books = scaled(np.array([r[0] for r in start], np.float64).reshape(len(start), size)).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
    books = np.ascontiguousarray(books)
    if not size:
        empty = F.lit("00" * parts if start else "").alias("code")
        return kept.select("vec_id", "label", empty, F.lit(0).cast("long").alias("error")), books
    blocks = forest(kept, size, parts)
    for _ in range(rounds):
        books = refined(blocks, books)
    return coded(blocks, books), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = cut(codes, "codes")
    by_label = cut(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "code-labels")
    out = codes.join(by_label, codes["label"].eqNullSafe(by_label["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """One assignment and one update a round, on lists of exact doubles."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT p.part, p.r, min(CAST(p.pp + b.zz - 2 * list_inner_product(p.ps, b.z) AS BIGINT) * 256 + b.entry) AS m FROM p JOIN b{i} b ON p.part = b.part GROUP BY p.part, p.r)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} AS (SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.part, a.m % 256 AS entry, unnest(p.ps) AS v, generate_subscripts(p.ps, 1) AS pos FROM a{i} a JOIN p ON a.part = p.part AND a.r = p.r) GROUP BY part, entry, pos),
n{i} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS z FROM s{i} GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT part, entry, z, list_inner_product(z, z) AS zz FROM (SELECT b.part, b.entry, coalesce(n.z, b.z) AS z FROM b{i} b LEFT JOIN n{i} n ON b.part = n.part AND b.entry = n.entry))"""
            )
    return (
        """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT i, len(embedding) AS size, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM v),
k AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY i) AS r FROM (SELECT i FROM c GROUP BY i HAVING bool_and(x IS NOT NULL AND isfinite(x)))),
p AS MATERIALIZED (SELECT part, r, ps, list_inner_product(ps, ps) AS pp FROM (SELECT c.pos * 4 // c.size AS part, k.r, list(CAST(floor(1024 * c.x) AS DOUBLE) ORDER BY c.pos) AS ps FROM c JOIN k ON c.i = k.i GROUP BY ALL)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, ps AS z, pp AS zz FROM p WHERE r <= 256),
"""
        + ",\n".join(steps)
        + f""",
f AS MATERIALIZED (SELECT a.r, string_agg(printf('%02x', a.m % 256), '' ORDER BY a.part) AS code, CAST(sum(a.m // 256) AS BIGINT) AS error FROM a{ROUNDS} a GROUP BY a.r),
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(z) AS x, generate_subscripts(z, 1) AS pos FROM b{ROUNDS}))
SELECT v.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM f JOIN k ON f.r = k.r JOIN v ON v.i = k.i CROSS JOIN h
"""
    )


SQL = _sql()
