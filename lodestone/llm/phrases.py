"""Phrase collocation mining by hierarchical pair naming.

Every language's frequent words get ids. A phrase of k words is the pair of the ids of its two phrases of k - 1 words, which overlap;
pairs that are frequent over the whole corpus get ids in turn. Texts are read once into blocks of sequences of local numbers, in
which a task counts its distinct pairs. These are dealt to parts by their hash; a part adds up the counts of all blocks, names what is
frequent and answers each block with the names of its pairs. So a block's distinct pairs are shuffled once, packed, and never
occurrences. An id's pair are its parents: the counts of what a cut leaves, and what contains a phrase, follow them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import words
from lodestone.llm.common import cut, joined_bytes, map_arrow, release, slices, table

LONGEST, LEAST, COVER_PERCENT, TOP = 4, 30, 80, 2000
#: Bytes of text of a block, about, and words of the corpus for each part that pairs are dealt to by hash.
BLOCK, PART_WORDS = 4 << 20, 1 << 20
#: Parts that a language's phrases are ranked in before the best of all parts are.
SALTS = 64
#: What ends a piece, and all that parts words.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
_ENDS = np.isin(np.arange(256), [ord(c) for c in PIECE_ENDS])
_TO_SPACE = np.where(_ENDS, 10, np.arange(256)).astype(np.uint8)


def cut_long(data: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of texts that lie end to end in data, with further ones behind piece ends of long texts; and the text of each stretch."""
    edges, owner = [at[:1]], []
    for i in np.flatnonzero(np.diff(at) > most).tolist():
        ends = np.flatnonzero(_ENDS[data[at[i] : at[i + 1]]]) + at[i] + 1
        place = np.searchsorted(ends, np.arange(at[i] + most, at[i + 1], most))
        edges.append(np.unique(ends[place[place < len(ends)]]))
    whole = np.unique(np.concatenate([*edges, at]))
    owner = np.searchsorted(at, whole[:-1], "right") - 1
    return whole, owner


def packed(x: np.ndarray) -> bytes:
    """An array of integers as Zstandard over its bytes, first bytes first: small numbers cost little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpacked(column, row: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(column[row].as_buffer()), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def compact(ids: np.ndarray) -> np.ndarray:
    """A sequence with one -1 where several were."""
    gap = ids < 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    return ids[keep]


def encoded(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each group of texts (words, groups, counts), and the sequence of their numbers, -1 between pieces."""
    data = words.lower_ascii(data)
    split = _TO_SPACE[data]
    starts, ends, per_text = words.bounds(split, at)
    inside = np.concatenate([[0], np.cumsum(ends - starts)])
    held = np.zeros(len(data) + 1, np.int32)
    np.add.at(held, starts, 1)
    np.add.at(held, ends, -1)
    flat = data[np.cumsum(held[:-1]) > 0]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(inside.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
    index, dictionary = found.indices.to_numpy().astype(np.int64), found.dictionary
    owner = group[np.repeat(np.arange(len(at) - 1), np.diff(per_text))]
    key, number, counts = np.unique(owner * max(1, len(dictionary)) + index, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # frequent words have small numbers
    key, counts, place = key[order], counts[order], np.empty(len(key), np.int64)
    place[order] = np.arange(len(order))
    stops = np.concatenate([[0], np.cumsum(_ENDS[data])])
    fresh = np.zeros(len(starts), np.int64)  # a piece begins at this word
    fresh[1:] = stops[starts[1:]] != stops[ends[:-1]]
    fresh[per_text[:-1][(per_text[:-1] > 0) & (per_text[:-1] < len(starts))]] = 1
    sequence = np.full(len(starts) + fresh.sum(), -1, np.int32)
    sequence[np.arange(len(starts)) + np.cumsum(fresh)] = place[number]
    return dictionary.take(pa.array(key % max(1, len(dictionary)))), key // max(1, len(dictionary)), counts, sequence


def word_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of the whole texts: langs and their totals of words, the distinct words with their language's place and count, the sequence."""

    def read(batches):
        for b in slices(batches, 0, block):
            data, at = joined_bytes(b.column(0))
            names = b.column(1).dictionary_encode()
            lang, langs = names.indices.to_numpy(), names.dictionary
            edges, owner = cut_long(data, at, block)
            part = edges[:-1] // block
            for first in np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []:
                last = first + np.searchsorted(part[first:], part[first], "right")
                piece, own = edges[first : last + 1], lang[owner[first:last]].astype(np.int64)
                found, of, counts, sequence = encoded(data[piece[0] : piece[-1]], piece - piece[0], own)
                totals = np.bincount(of, counts, len(langs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((langs.to_pylist(), pa.list_(pa.string())), (totals, pa.list_(pa.int64())))]
                    + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (found.cast(pa.large_string()).cast(pa.string()), pa.array(of.astype(np.int32)), pa.array(counts))]
                    + [pa.array([packed(compact(sequence))], pa.binary())],
                    names=["langs", "totals", "words", "of", "counts", "sequence"],
                )

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    found = map_arrow(rows, read, "langs array<string>, totals array<bigint>, words array<string>, of array<int>, counts array<bigint>, sequence binary")
    return cut(found.withColumn("block", F.monotonically_increasing_id()), "phrase-words")  # numbered once, as it is written


def pair_blocks(named: DataFrame, parts: int, ids_of) -> DataFrame:
    """Of named blocks the sequences of the numbers of their pairs (part -1), and a row for each part of the pairs that occur: their
    ids and counts, in an order by which a block's numbers of one part follow each other from `start` on.

    ids_of(batch, row) gives the ids of a block's numbers, -1 where a number has none; the block and its sequence come first.
    """

    def pairs(batches):
        for b in batches:
            for r in range(b.num_rows):
                sequence = unpacked(b.column(1), r, np.int32)
                ids = ids_of(b, r)
                ids = np.concatenate([ids, np.full(max(0, int(sequence.max(initial=-1)) + 1 - len(ids)) + 1, -1, np.int64)])  # the last is that of -1
                known, dense = np.unique(ids, return_inverse=True)
                now = dense[sequence]
                both = np.flatnonzero((now[:-1] > 0) & (now[1:] > 0))
                if not len(both):
                    continue
                key, number, counts = np.unique(now[both] * len(known) + now[both + 1], return_inverse=True, return_counts=True)
                left, right = known[key // len(known)], known[key % len(known)]
                part = (words.mixed(words.mixed(left.view(np.uint64)) + right.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                out = np.full(len(now), -1, np.int32)
                out[both] = place[number]
                part, left, right, counts = part[order], left[order], right[order], counts[order].astype(np.int32)
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(part)]))
                block, none = b.column(0)[r].as_py(), [None] * len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1, *part[first].tolist()], pa.int32()), pa.array([block] * (len(cuts) + 1), pa.int64()), pa.array([0, *first.tolist()], pa.int32()), pa.array([packed(compact(out)), *none], pa.binary())]
                    + [pa.array([None, *[packed(x[s:e]) for s, e in cuts]], pa.binary()) for x in (left, right, counts)],
                    names=["part", "block", "start", "sequence", "lefts", "rights", "counts"],
                )

    return cut(map_arrow(named, pairs, "part int, block bigint, start int, sequence binary, lefts binary, rights binary, counts binary"), "phrase-pairs")


def named_pairs(blocks: DataFrame, least: int) -> DataFrame:
    """Of the pairs of all blocks, part by part: the frequent ones with their counts (block -1), whose id is the part and the place
    there; and for each block the places of its pairs from `start` on, -1 for those that are not frequent."""

    def join(batches):
        held: list[tuple] = []
        for b in itertools.chain(batches, [None]):
            for r in range(1 if b is None else b.num_rows):
                if held and (b is None or b.column(0)[r].as_py() != held[0][0]):
                    yield from name(held)
                    held = []
                if b is not None:
                    held.append((*[b.column(i)[r].as_py() for i in range(3)], *[unpacked(b.column(i), r, t) for i, t in ((3, np.int64), (4, np.int64), (5, np.int32))]))

    def name(held):
        left, right, count = (np.concatenate([h[i] for h in held]) for i in (3, 4, 5))
        known, dense = np.unique(np.concatenate([left, right]), return_inverse=True)
        key, pair = np.unique(dense[: len(left)] * len(known) + dense[len(left) :], return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, pair, count)
        often = total >= least
        if not often.any():
            return
        place = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)[pair]
        part, edges = held[0][0], np.concatenate([[0], np.cumsum([len(h[3]) for h in held])])
        found = [(h[1], h[2], place[s:e]) for h, s, e in zip(held, edges, edges[1:])]
        found = [f for f in found if (f[2] >= 0).any()]
        lists = (known[key[often] // len(known)], known[key[often] % len(known)], total[often])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * (len(found) + 1), pa.int32()), pa.array([-1, *[f[0] for f in found]], pa.int64()), pa.array([0, *[f[1] for f in found]], pa.int32()), pa.array([None, *[packed(f[2]) for f in found]], pa.binary())]
            + [pa.array([x.tolist(), *[None] * len(found)], pa.list_(pa.int64())) for x in lists],
            names=["part", "block", "start", "places", "lefts", "rights", "totals"],
        )

    rows = blocks.where("part >= 0").select("part", "block", "start", "lefts", "rights", "counts").repartition("part").sortWithinPartitions("part")
    return cut(map_arrow(rows, join, "part int, block bigint, start int, places binary, lefts array<bigint>, rights array<bigint>, totals array<bigint>"), "phrase-names")


def _by_number(batch: pa.RecordBatch, row: int) -> np.ndarray:
    number, ids = (batch.column(c)[row].values.to_numpy() for c in (2, 3))
    out = np.full(int(number.max(initial=-1)) + 1, -1, np.int64)
    out[number] = ids
    return out


def _by_part(batch: pa.RecordBatch, row: int) -> np.ndarray:
    held = batch.column(4)[row].values
    places = [unpacked(held, i, np.int32).astype(np.int64) for i in range(len(held))]
    starts, parts = (batch.column(c)[row].values.to_pylist() for c in (2, 3))
    out = np.full(max(s + len(p) for s, p in zip(starts, places)), -1, np.int64)
    for s, part, p in zip(starts, parts, places):
        out[s : s + len(p)] = np.where(p >= 0, p + (part << 32), -1)
    return out


def levels(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(n of each lang; the frequent phrases of 1, 2, ... words: id, left, right, a, and of words lang and word).

    What meets in a block again, when names come back to it, is no more than it held.
    """
    blocks = word_blocks(docs)
    totals = cut(blocks.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n")), "phrase-totals")
    parts = int((totals.agg(F.sum("n")).first()[0] or 0) // PART_WORDS) + 1
    each = blocks.select("block", "langs", F.posexplode(F.arrays_zip("words", "of", "counts")).alias("number", "x"))
    local = each.select("block", "number", F.get("langs", F.col("x.of")).alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    frequent = local.groupBy("lang", "word").agg(F.sum("c").alias("a")).where(F.col("a") >= least)
    found = [cut(frequent.withColumn("id", F.monotonically_increasing_id()), "phrase-1")]  # numbered once, as it is written
    names = local.select("block", "number", "lang", "word").join(found[0].select("id", "lang", "word"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("number", "id")).alias("m"))
    named, ids_of = blocks.select("block", "sequence").join(names, "block").select("block", "sequence", "m.number", "m.id"), _by_number
    for _ in range(2, longest + 1):
        before, blocks = blocks, pair_blocks(named, parts, ids_of)
        release(before)  # the new blocks are written, and nothing reads the old ones again
        pairs = named_pairs(blocks, least)
        each = pairs.where("block = -1").select("part", F.posexplode(F.arrays_zip("lefts", "rights", "totals")).alias("place", "x"))
        found.append(each.select((F.shiftleft(F.col("part").cast("long"), 32) + F.col("place")).alias("id"), F.col("x.lefts").alias("left"), F.col("x.rights").alias("right"), F.col("x.totals").alias("a")))
        names = pairs.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("start", "part", "places")).alias("m"))
        named, ids_of = blocks.where("part = -1").select("block", "sequence").join(names, "block").select("block", "sequence", "m.start", "m.part", "m.places"), _by_part
    return totals, found


def spelled(found: list[DataFrame]) -> list[DataFrame]:
    """The phrases with lang, phrase, last word, and the counts of their beginnings and ends of 1, 2, ... words, through their parents."""
    out = [found[0].select("id", "lang", "a", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("a").alias("begins"), F.array("a").alias("ends"))]
    for own in found[1:]:
        left = out[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), "begins")
        right = out[-1].select(F.col("id").alias("right"), "last", "ends")
        both = own.join(left, "left").join(right, "right")
        out.append(cut(both.select("id", "left", "right", "lang", "a", F.concat_ws(" ", "head", "last").alias("phrase"), "last", F.concat("begins", F.array("a")).alias("begins"), F.concat("ends", F.array("a")).alias("ends")), "phrase-spelled"))
    return out


def _exact(column):
    return f"cast({column} as decimal(20,0))"


def best_cut(size: int):
    """The lowest-scoring cut of phrases of `size` words: (score, k, l, r)."""
    score = lambda k: F.expr(f"2000000 * {_exact('a')} div ({_exact(f'get(begins, {k - 1})')} + {_exact(f'get(ends, {size - k - 1})')})")
    cuts = [F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.get("begins", F.lit(k - 1)).alias("l"), F.get("ends", F.lit(size - k - 1)).alias("r")) for k in range(1, size)]
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cover: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z), split at . , ; : ! ? and line ends into pieces, and those at spaces and tabs into words; a phrase lies
    within a piece. a counts all its occurrences, n all words of the language (a null lang is `und`). Phrases with a >= least are
    cut in two where floor(2000000 * a / (l + r)) is lowest, the first of equal ones; l and r count the occurrences of both sides. A
    phrase inside a longer one that has cover percent of its occurrences is dropped. Ranks go by score and a, descending, then
    by phrase. Null and empty texts have no words; a null or repeated doc_id makes no difference, every row counts. An empty table gives an
    empty one. Other columns are ignored. Whatever contains a phrase contains it through a parent with as many occurrences or more,
    so the direct children of a phrase decide whether it is dropped.
    """
    totals, found = levels(docs, longest, least)
    named = spelled(found)
    kept = None
    for k in range(2, longest + 1):
        own = named[k - 1].select("id", "lang", "phrase", "a", best_cut(k).alias("s"))
        if k < longest:
            children = found[k].select(F.explode(F.array("left", "right")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("most"))
            own = own.join(children, "id", "left").where(F.expr(f"most is null or 100 * {_exact('most')} < {cover} * {_exact('a')}"))
        own = own.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
        kept = own if kept is None else kept.unionByName(own)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = W.partitionBy("lang", "salt").orderBy(*order)
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
places AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
s AS (SELECT x.*, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * x.a // (l.a::HUGEINT + r.a) AS BIGINT) AS score FROM cuts x JOIN f l ON l.lang = x.lang AND l.g = x.g[1:x.c] JOIN f r ON r.lang = x.lang AND r.g = x.g[x.c + 1:]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_of AS (SELECT lang, k, a, g, unnest(range(2, k)) AS size FROM f WHERE k > 2),
sub AS (SELECT lang, g[i:i + size - 1] AS g, max(a) AS most FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM inner_of) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN sub ON sub.lang = b.lang AND sub.g = b.g WHERE sub.most IS NULL OR 100::HUGEINT * sub.most < 80::HUGEINT * b.a),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
