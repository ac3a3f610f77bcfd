"""MinHash near-dedup by a chosen-path set similarity join.

Documents walk down independent trees: a node picks one or two coordinates of the MinHash signature, and documents that agree
there share a child. Nodes of a few documents are compared exhaustively, larger ones branch on, and what is still large after
all levels is compared in blocks. In a first round each member's likeliest partners are confirmed on the full shingle sets. In a
second round every other pair that can be similar and still lies in two components is checked where it meets, on the full sets,
and only the links that join components leave the node: rows grow with the members, not with their pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import words
from lodestone.llm.common import cut, joined_bytes, map_arrow, settled, slices, table
from lodestone.llm.components import components

SHINGLE = 5
#: Coordinates that paths choose from (32 bits each), and the bins that similarities are estimated with (two bits each).
COORDINATES, BINS = 64, 1024
SIGNATURE = 4 * COORDINATES + BINS // 4
#: Trees and their depth; how many nodes of 16 have two coordinates, so that at similarity 0.8 as many paths are shared on a deeper
#: level as above; the largest node compared exhaustively, and how many of the likeliest partners a member keeps from one node in
#: the first round.
TREES, DEPTH, BRANCHING, SMALL, PARTNERS = 8, 8, 4, 2048, 2
#: Shingles of a block of a node whose members' full sets are compared.
BLOCK_SHINGLES = 1 << 20
#: Pairs whose signatures are compared at once.
CHUNK = 1 << 15
#: Pairs of a node that wait in memory to be ranked or written.
HELD = 1 << 20
#: Fixed seeds of the coordinates' permutations.
_RNG = np.random.Generator(np.random.PCG64(20240501))
_A = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of `size` words, or the whole sequence where there are fewer words."""
    data = words.lower_ascii(data)
    starts, ends, per_text = words.bounds(data, at)
    h = words.hashes(data, starts, ends)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size if len(rolled) else 0):
        rolled = rolled * np.uint64(words.BASE) + h[j : len(h) - size + 1 + j]
    rolled = words.mixed(rolled)
    out = []
    for s, e in zip(per_text.tolist(), per_text[1:].tolist()):
        if e - s >= size:
            x = np.sort(rolled[s : e - size + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif e > s:
            whole = np.uint64(e - s)
            with np.errstate(over="ignore"):
                for v in h[s:e]:
                    whole = whole * np.uint64(words.FACTOR) + v
            out.append(words.mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _chunks(sets: list[np.ndarray], most: int, rows: int):
    """(first, end) of stretches of sets with about `most` shingles and `rows` sets at most."""
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and j - i < rows and (total == 0 or total + len(sets[j]) <= most):
            total += len(sets[j])
            j += 1
        yield i, j
        i = j


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """A (sets, COORDINATES) matrix of 32-bit values; the sets must not be empty."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    for i, j in _chunks(sets, 1 << 15, 1 << 15):  # what the processor's cache holds
        flat = np.concatenate(sets[i:j])
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        work = np.empty_like(flat)
        for c in range(COORDINATES):
            np.bitwise_xor(flat, _B[c], out=work)
            np.multiply(work, _A[c], out=work)
            out[i:j, c] = (words.mixed(np.minimum.reduceat(work, first)) >> np.uint64(32)).astype(np.uint32)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS / 4) bytes: which of BINS bins hold a shingle, then one bit of the least shingle in each. One pass over the set;
    of sets with fewer shingles than bins nearly every shingle is seen."""
    out = np.zeros((len(sets), BINS // 4), np.uint8)
    for i, j in _chunks(sets, 1 << 18, 1 << 12):
        flat = words.mixed(np.concatenate(sets[i:j]) ^ np.uint64(words.FACTOR))
        row = np.repeat(np.arange(j - i, dtype=np.uint64), [len(s) for s in sets[i:j]])
        flat = np.sort((row << np.uint64(52)) | (flat >> np.uint64(12)))  # row, 10 bits of bin, the rest
        where = (flat >> np.uint64(42)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        held, bit = np.zeros((2, (j - i) * BINS), bool)
        held[where[first]] = True
        bit[where[first]] = (flat[first] & np.uint64(1)).astype(bool)
        out[i:j] = np.hstack([np.packbits(x.reshape(j - i, BINS), axis=1) for x in (held, bit)])
    return out


def estimated(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarity in thousandths, whether it can be percent or more) of pairs of sketches (as rows of 64-bit words) of sets of so many shingles.

    Bins with equal bits less those with different ones estimate the bins whose least shingle both hold. The bound is four standard
    deviations: those of the bits, and those of a sample of so many of the union's shingles, without putting back.
    """
    half = left.shape[1] // 2
    count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
    both = left[:, :half] & right[:, :half]
    seen = count(left[:, :half] | right[:, :half])
    differ = count(both & (left[:, half:] ^ right[:, half:]))
    equal = count(both) - 2 * differ
    s = percent / 100
    union = (n_left + n_right) / (1 + s)
    spread = np.sqrt(seen * s * (1 - s) * np.clip(1 - seen / union, 0, 1) + 2 * differ + 1)
    return 1000 * equal // np.maximum(1, seen), equal >= seen * s - 4 * spread - 2


def digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit halves of a digest of each set."""
    found = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (hash of the text), n_shingles, a 128-bit digest (d1, d2) of the set, and the signature (null for an empty set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for b in slices(batches, 1, 1 << 20):
            sets = shingle_sets(*joined_bytes(b.column(1)))
            full = [i for i, s in enumerate(sets) if len(s)]
            packed = [None] * len(sets)
            if full:
                paths, bins = minhash([sets[i] for i in full]), sketches([sets[i] for i in full])
                for row, i in enumerate(full):
                    packed[i] = paths[row].tobytes() + bins[row].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), *digests(sets), pa.array(packed, pa.binary())], names=["doc_id", "row_key", "n_shingles", "d1", "d2", "sig"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("row_key")), sign, f"doc_id {kind}, row_key bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary")


def chosen(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two coordinates for each node key, the second -1 for all but BRANCHING nodes of 16."""
    a = words.mixed(node + np.uint64(words.FACTOR))
    b = words.mixed(a)
    first = (a % np.uint64(COORDINATES)).astype(np.int64)
    second = (first + 1 + (b % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    return first, np.where(b >> np.uint64(60) < BRANCHING, second, -1)


def children(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child keys, row numbers) of rows at the given nodes with their signatures."""
    keys, rows = [], []
    for c in chosen(node):
        use = np.flatnonzero(c >= 0)
        value = sig[use, c[use]].astype(np.uint64)
        with np.errstate(over="ignore"):
            keys.append(words.mixed(node[use] * np.uint64(words.BASE) + (c[use].astype(np.uint64) << np.uint64(32)) + value))
        rows.append(use)
    return np.concatenate(keys), np.concatenate(rows)


def _paths(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(_signatures(column)[:, : 4 * COORDINATES]).view(np.uint32)


def _signatures(column: pa.Array) -> np.ndarray:
    return joined_bytes(column)[0].reshape(-1, SIGNATURE) if len(column) else np.zeros((0, SIGNATURE), np.uint8)


def _bins(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(_signatures(column)[:, 4 * COORDINATES :]).view(np.uint64)


def likeliest(left: np.ndarray, right: np.ndarray, est: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs are among the `most` best of either of their ends."""
    ends, which = np.concatenate([left, right]), np.concatenate([np.arange(len(left))] * 2)
    if not len(ends):
        return which
    order = np.lexsort((which, -est[which], ends))
    first = np.concatenate([[True], ends[order][1:] != ends[order][:-1]])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return np.unique(which[order][rank < most])


def meetings(reps: DataFrame, trees: int = TREES, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """(node, rep, c, side): the nodes of 2 to `small` members (side 0), and in cells those still larger after all levels.

    A large node is cut into blocks of about 2 * small members (see in_cells), so every two members meet in one cell, over many tasks.
    """

    def roots(batches):
        for b in batches:
            sig, rep = _paths(b.column(1)), b.column(0)
            for t in range(trees):
                root = np.full(len(sig), words.mixed(np.array([t + 1], np.uint64))[0])
                keys, rows = children(root, sig)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), rep.take(pa.array(rows))], names=["node", "rep"])

    def branch(batches):
        for b in batches:
            keys, rows = children(b.column(0).to_numpy().view(np.uint64), _paths(b.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(1).take(pa.array(rows))], names=["node", "rep"])

    active = map_arrow(reps.select("rep", "sig"), roots, "node bigint, rep bigint")
    leaves = []
    for level in range(1, depth + 1):
        active = cut(active, "paths")
        sizes = active.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
        marked = cut(active.join(sizes, "node"), "nodes")
        leaves.append(marked.where(F.col("c") <= small).select("node", "rep", "c", F.lit(0).alias("side")))
        large = marked.where(F.col("c") > small).select("node", "rep", "c")
        if not large.limit(1).count():
            large = None
            break
        if level < depth:
            active = map_arrow(large.join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig"), branch, "node bigint, rep bigint")
    met = leaves[0]
    for more in leaves[1:]:
        met = met.unionByName(more)
    if large is not None:
        met = met.unionByName(in_cells(large.withColumn("blocks", F.ceil(F.col("c") / F.lit(2 * small)))).select("node", "rep", "c", "side"))
    return met


def in_cells(large: DataFrame) -> DataFrame:
    """Rows (node, rep, blocks, ...) dealt to `blocks` blocks of each node by hash, and from these to cells, the new nodes.

    Each two blocks of a node share a cell, with sides 1 and 2 that meet each other alone; a block's own cell has side 0.
    """
    cells = large.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    key = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return cells.withColumns({"node": key, "side": side}).drop("own", "other", "blocks")


def index_pairs(size: int):
    """All i < j below size, about CHUNK pairs at a time."""
    rows = max(1, CHUNK // size)
    for s in range(0, size - 1, rows):
        i, j = np.triu_indices(min(rows, size - s), s + 1, size)
        yield i + s, j


def nodes_of(batches, columns: int):
    """Lists of columns, of rows sorted by the first one, the node, such that each node's rows come together; the last holds what may go on."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            now = [b.column(i).to_numpy() for i in range(columns)] + [_bins(b.column(columns))] + [b.column(i).to_pylist() for i in range(columns + 1, b.num_columns)]
            held = now if held is None else [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(held, now)]
        if held is None or not len(held[0]):
            continue
        last = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))  # the last node may go on in the next batch
        if last:
            yield [x[:last] for x in held]
        held = [x[last:] for x in held] if b is not None else None


def node_pairs(rows: list, percent: int):
    """(x, y, est) of the rows (node, rep, side, n, label, bins) that share a node, an array of pairs at a time, those of one node
    never apart from each other by another's: pairs whose sizes and sketches allow the similarity, of unequal labels and not of
    one side 1 or 2. None parts groups of nodes."""
    node, _, side, n, label, bins = rows[:6]
    edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
    size = np.diff(edge)
    for g in np.unique(size[size > 1]):
        first = edge[:-1][size == g]
        step = max(1, 2 * CHUNK // int(g * (g - 1)))
        for s in range(0, len(first), step):
            for i, j in index_pairs(int(g)):
                x, y = ((first[s : s + step, None] + k).ravel() for k in (i, j))
                ok = (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] == 0)) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                x, y = x[ok], y[ok]
                est, ok = estimated(bins[x], bins[y], n[x], n[y], percent)
                yield x[ok], y[ok], est[ok]
            yield None


def by_node(met: DataFrame, reps: DataFrame, *more: str) -> DataFrame:
    """The members (node, rep, side) with n, label, sig and more columns of reps, a node's rows together."""
    return met.join(reps, "rep").select("node", "rep", "side", "n", "label", "sig", *more).repartition("node").sortWithinPartitions("node")


def candidates(met: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, est) with a < b: pairs of reps (rep, n, sig) that meet in nodes (node, rep, side), among the PARTNERS likeliest of one of their ends there."""

    def pairs(batches):
        for rows in nodes_of(batches, 5):
            rep, parts, waiting = rows[1], [], 0
            for found in node_pairs(rows, percent):
                if found is not None:
                    parts.append(found)
                    waiting += len(found[0])
                if parts and (found is None or waiting > HELD):  # what is not among the likeliest of some pairs is not among those of more
                    x, y, est = (np.concatenate(p) for p in zip(*parts))
                    ok = likeliest(x, y, est, PARTNERS)
                    x, y, est = x[ok], y[ok], est[ok]
                    parts, waiting = ([(x, y, est)], 0) if found is not None else ([], 0)
                    if found is None and len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y])), pa.array(est.astype(np.int32))], names=["a", "b", "est"])

    found = map_arrow(by_node(met, reps.withColumn("label", F.col("rep"))), pairs, "a bigint, b bigint, est int")
    return cut(found.groupBy("a", "b").agg(F.max("est").alias("est")), "pairs")


def shared_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair share, from bit rows over the shingles that two sets at least hold."""
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    flat, row = np.concatenate([sets[i] for i in used.tolist()]), np.repeat(np.arange(len(used)), [len(sets[i]) for i in used.tolist()])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(fresh) - 1
    often = np.bincount(column)[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    out = np.zeros(len(x), np.int64)
    wide = 1 << 14
    for first in range(0, int(column.max(initial=-1)) + 1, wide):
        low, high = np.searchsorted(column, [first, first + wide])
        bits = np.zeros((len(used), min(wide, -(-(int(column.max()) + 1 - first) // 64) * 64)), bool)
        bits[row[low:high], column[low:high] - first] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, (1 << 21) // packed.shape[1])
        for s in range(0, len(x), step):
            out[s : s + step] += np.bitwise_count(packed[x[s : s + step]] & packed[y[s : s + step]]).sum(1, dtype=np.int64)
    return out


def first_meetings(home: np.ndarray, nodes: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) of rows are for their node to check: of the nodes with side 0 that both are in, the one with the smallest key;
    each cell of a large node's two blocks, where there is none. nodes: the sorted keys of each row's nodes with side 0, 8 bytes each."""
    out = np.ones(len(x), bool)
    if not len(x):
        return out
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    lists = [np.frombuffer(nodes[i], ">i8") for i in used.tolist()]
    held = np.zeros((len(used), max(1, max(map(len, lists)))), np.int64)
    there = np.arange(held.shape[1]) < np.array([len(n) for n in lists])[:, None]
    held[there] = np.concatenate(lists)
    step = max(1, (1 << 21) // held.shape[1] ** 2)
    for s in range(0, len(x), step):
        left, right = at[: len(x)][s : s + step], at[len(x) :][s : s + step]
        both = (held[left][:, :, None] == held[right][:, None, :]) & there[left][:, :, None] & there[right][:, None, :]
        common = both.any(2)
        first = np.where(common.any(1), held[left, common.argmax(1)], home[x[s : s + step]])
        out[s : s + step] = first == home[x[s : s + step]]
    return out


class Joined:
    """Which components links have joined, for whole arrays of them."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def tops(self, x: np.ndarray) -> np.ndarray:
        while (self.parent != self.parent[self.parent]).any():
            self.parent = self.parent[self.parent]
        return self.parent[x]

    def add(self, i: int, j: int) -> bool:
        for _ in range(2):
            while self.parent[i] != i:
                i = int(self.parent[i])
            i, j = j, i
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def joining(met: DataFrame, reps: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of reps (rep, n, sig) on full sets (rep, set) that join the components given by labels (id, component).

    Every pair that meets in a node (node, rep, c, side) of more than PARTNERS + 1 members, can be similar and lies in two
    components counts: it is checked on the full sets, in one of the nodes that it meets in, unless links found in the same batch already
    join its components. First the members of such pairs are named, so that sets are sent to the nodes that need them alone.
    """
    named = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "n", "sig", F.coalesce("component", "rep").alias("label"))

    # a rep is in a few nodes a tree; those whose members all meet (side 0) say which one checks a pair, as 8 bytes each
    keys = F.transform(F.sort_array(F.collect_set("node")), lambda x: F.lpad(F.hex(x), 16, "0"))
    small = met.where(f"side = 0 and c > {PARTNERS + 1}").groupBy("rep").agg(F.unhex(F.array_join(keys, "")).alias("nodes"))
    named = cut(named, "named-reps")

    def members(batches):
        for rows in nodes_of(batches, 5):
            wanted = np.zeros(len(rows[0]), bool)
            for found in node_pairs(rows, percent):
                if found is not None:
                    wanted[found[0]] = wanted[found[1]] = True
            if wanted.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[k][wanted]) for k in (0, 1, 2, 3)], names=["node", "rep", "side", "n"])

    large = met.where(F.col("c") > PARTNERS + 1).select("node", "rep", "side")
    wanted = cut(map_arrow(by_node(large, named), members, "node bigint, rep bigint, side int, n bigint"), "wanted-members")
    blocks = cut(wanted.groupBy("node").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks")), "node-blocks")
    dealt = wanted.join(blocks, "node").withColumn("home", F.col("node"))
    lone = dealt.where("blocks = 1").select("node", "rep", "side", "home")
    split = in_cells(dealt.where("blocks > 1").select("node", "rep", "home", "blocks")).select("node", "rep", "side", "home")  # sides of a cell within a cell only save work

    def links(batches):
        for rows in nodes_of(batches, 5):
            rep, sets, nodes, home = rows[1], [np.frombuffer(x, np.uint64) for x in rows[6]], rows[7], np.array(rows[8], np.int64)
            n, parts, waiting = np.array([len(s) for s in sets]), [], 0
            _, place = np.unique(np.stack([rows[0], rows[4]], 1), axis=0, return_inverse=True)
            place, joined, a, b = place.ravel(), Joined(len(sets)), [], []

            def check(parts):
                x, y, est = (np.concatenate(p) for p in zip(*parts))
                order = np.lexsort((y, x, -est))
                x, y = x[order], y[order]
                for s in range(0, len(x), CHUNK):
                    i, j = x[s : s + CHUNK], y[s : s + CHUNK]
                    open_ = joined.tops(place[i]) != joined.tops(place[j])
                    i, j = i[open_], j[open_]
                    if not len(i):
                        continue
                    both = shared_counts(sets, i, j)
                    ok = 100 * both >= percent * (n[i] + n[j] - both)
                    for p, q in zip(i[ok].tolist(), j[ok].tolist()):
                        if joined.add(int(place[p]), int(place[q])):
                            a.append(min(rep[p], rep[q]))
                            b.append(max(rep[p], rep[q]))

            for found in itertools.chain(node_pairs(rows, percent), [None]):
                if found is not None:
                    own = first_meetings(home, nodes, found[0], found[1])
                    parts.append(tuple(f[own] for f in found))
                    waiting += int(own.sum())
                if waiting and (found is None or waiting > HELD):
                    check(parts)
                    parts, waiting = [], 0
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # only members that are compared carry their keys: lists get longer with the corpus
    asked = wanted.select("rep").distinct()
    held = named.join(sets, "rep").join(small.join(asked, "rep", "left_semi"), "rep", "left").withColumn("nodes", F.coalesce("nodes", F.lit(b"")))
    rows = lone.unionByName(split).join(held, "rep").select("node", "rep", "side", "n", "label", "sig", "set", "nodes", "home").repartition("node").sortWithinPartitions("node")
    return map_arrow(rows, links, "a bigint, b bigint")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (rep, set: sorted 64-bit hashes) reach the similarity."""

    def exact(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), exact, "a bigint, b bigint")


def _relabelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the components of both ends, without those inside one component."""
    for end in ("a", "b"):
        named = labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(named, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("ca != cb")


def near_duplicates(docs: DataFrame, percent: int = 80, trees: int = TREES) -> DataFrame:
    """doc_id, row_key (hash of the text), n_shingles, component_id, kept for every row of docs.

    A-Z are lower-cased; a document's set holds its distinct 5-word shingles (fewer words: the whole sequence as one; none, or
    a null text: empty). Documents with 100 * intersection >= percent * union of non-empty sets are linked; component_id is
    the smallest doc_id reachable, and that document is kept. Equal sets are one node of the join, so copies cost nothing more.
    Recall of a link whose documents meet in small nodes is 1 - (1 - s)^trees or better at similarity s; tests measure it where
    every node is large. Every reported link is exact. doc_id may be of any type with an order. Rows with equal ids and other
    texts are judged each by its own text. A null doc_id is linked with nothing, has no component and is kept. An empty table
    gives an empty one. Other columns are ignored. Only the result's file stays; signatures and sets go when it is written.
    """
    return settled(docs.sparkSession, "near-duplicates", lambda: _near_duplicates(docs, percent, trees))


def _near_duplicates(docs: DataFrame, percent: int, trees: int) -> DataFrame:
    signed = cut(signatures(docs), "signatures")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbered once, as it is written
    reps = classes.select("rep", "n", "sig")
    met = cut(meetings(reps, trees), "met")
    pairs = candidates(met, reps, percent)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = cut(classes.join(wanted, "rep", "left_semi").select("rep", F.col("first").alias("doc_id"), "d1", "d2"), "wanted")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def full(batches):
        for b in slices(batches, 1, 1 << 20):
            sets = shingle_sets(*joined_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "d1", "d2", "set"])

    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = map_arrow(texts, full, f"doc_id {kind}, d1 bigint, d2 bigint, set binary").join(wanted, ["doc_id", "d1", "d2"]).select("rep", "set")
    sets = cut(sets.dropDuplicates(["rep"]), "sets")  # rows of one class have equal sets

    # first each document's likeliest pair, then the other pairs between components, then all that the first round left out between them
    ends = pairs.select(F.explode(F.array(F.struct("a", "b", "est", F.col("a").alias("v")), F.struct("a", "b", "est", F.col("b").alias("v")))).alias("e")).select("e.*")
    best = ends.groupBy("v").agg(F.max(F.struct("est", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
    links = cut(confirm(best, sets, percent), "links")
    between = _relabelled(pairs, components(links, rounds=2)).select("a", "b")  # rough labels do: they only save checks inside a component
    links = cut(links.unionByName(confirm(between, sets, percent)), "links")
    labels = components(links)
    labels = components(links.unionByName(cut(joining(met, reps, sets, labels, percent), "joining")))
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "first", F.coalesce("component", "rep").alias("component"))
    named = cut(named, "named")
    smallest = cut(named.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    named = named.join(smallest, "component").select("d1", "d2", "component_id")
    out = signed.select("doc_id", "row_key", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")
