"""Substring dedup by sliding sentence spans: hash runs of consecutive sentences, join globally, remove what is not first."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import words
from lodestone.llm.common import cut, map_arrow, slices, table

MIN_SENTENCES, LONG_SENTENCE = 2, 25
#: A run counts for the query if the words of a corpus, drawn one by one, would make it again with less than this probability.
CHANCE = 0.001
#: Counters of words (by hash; words that share one look more frequent than they are), and the unit of information: 1/256 bit.
COUNTERS, BIT = 1 << 16, 256
#: Words to either side that a cut inside a long sentence must be least among, by a hash of the word and the two before.
REACH = 8
#: Ranges of letters of scripts written without spaces (Thai to Lao, Myanmar, Khmer, kana, Han), each a word of its own.
UNSPACED = ((0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
STOPS = ".!?\n։؟۔।॥።。！．？｡"
_PLANE = 1 << 16
_SPACE = np.array([chr(i).isspace() for i in range(_PLANE)])
_LOWER = np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(_PLANE)], np.uint32)
_STOP = np.isin(np.arange(_PLANE), [ord(c) for c in STOPS])


class Sentences:
    """The sentences of a batch of texts: of sentence i the text, the first word, and the characters [start, end) in its text.

    Sentences go up to . ! ? (and other scripts' stops) or the line's end; those without words are none. Words are parted by white
    space; letters of scripts without spaces are words each. A sentence of more than LONG_SENTENCE words is cut after words where
    the hash of the last three is least in REACH words to both sides, the first of equal ones, and every LONG_SENTENCE words from
    such a place or the sentence's start. So what texts share is cut alike, wherever it stands.
    """

    def __init__(self, texts: list[str]):
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        plane = np.minimum(codes, _PLANE - 1)
        space, stop = _SPACE[plane], _STOP[plane]
        codes = np.where(codes < _PLANE, _LOWER[plane], codes)
        alone = np.zeros(len(codes), bool)
        if len(codes) and codes.max() >= UNSPACED[0][0]:
            for low, high in UNSPACED:
                alone |= (codes >= low) & (codes <= high)
        fresh = np.zeros(len(codes), bool)  # a text's or a sentence's first character
        fresh[1:] = stop[:-1] & ~stop[1:]
        fresh[at[:-1][at[:-1] < len(codes)]] = True
        start = ~space
        start[1:] &= space[:-1] | fresh[1:] | ((alone[1:] | alone[:-1]) & ~stop[1:])
        end = ~space
        end[:-1] &= space[1:] | start[1:] | fresh[1:]
        word_start, word_end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.hash = words.hashes(codes, word_start, word_end)
        new = self._cut(np.cumsum(fresh)[word_start])
        self.first = np.append(np.flatnonzero(new), len(word_start))  # the first word of each sentence, and the count of words
        begin = word_start[self.first[:-1]]
        self.text = np.searchsorted(at, begin, "right") - 1
        self.start, self.end = begin - at[self.text], word_end[self.first[1:] - 1] - at[self.text]
        self.of_text = np.searchsorted(self.text, np.arange(len(texts) + 1))  # the first sentence of each text, and the count

    def _cut(self, sentence: np.ndarray) -> np.ndarray:
        """Which words begin a sentence or a piece of a long one."""
        n = len(sentence)
        new = np.ones(n, bool)
        new[1:] = sentence[1:] != sentence[:-1]
        begins = np.flatnonzero(new)
        size = np.diff(np.append(begins, n))
        long = np.flatnonzero(np.repeat(size > LONG_SENTENCE, size))
        if not len(long):
            return new
        h, own = self.hash[long], sentence[long]
        mark = h * np.uint64(words.FACTOR)
        for back, factor in ((1, words.BASE), (2, 0x2545F4914F6CDD1D)):
            same = own[back:] == own[:-back]
            mark[back:] += np.where(same, h[:-back], np.uint64(0)) * np.uint64(factor)
        mark = words.mixed(mark)
        least = np.ones(len(long), bool)
        for r in range(1, REACH + 1):
            same = own[r:] == own[:-r]
            least[r:] &= ~same | (mark[r:] < mark[:-r])
            least[:-r] &= ~same | (mark[:-r] <= mark[r:])
        after = long[least] + 1
        new[after[after < n]] = True
        i = np.arange(n)
        return new | ((i - np.maximum.accumulate(np.where(new, i, 0))) % LONG_SENTENCE == 0)

    def runs(self, min_sentences: int, least: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the shortest run from each sentence on, and of the shortest up to each, with so many sentences and so much
        weight: that of its words by their counters, or one each.

        A sentence of a repeated run of any length is covered by one of these that lies inside it, so these find what all runs find.
        """
        n = len(self.text)
        low, high = self.of_text[self.text], self.of_text[self.text + 1]
        i = np.arange(n)
        before = self.first if weights is None else np.concatenate([[0], np.cumsum(weights[self.counters()])])[self.first]
        end = np.maximum(i + min_sentences, np.searchsorted(before, before[:-1] + least))
        ok = end <= high
        begin = np.minimum(i + 1 - min_sentences, np.searchsorted(before, before[1:] - least, "right") - 1)
        back = begin >= low
        back[back] = end[begin[back]] != i[back] + 1  # those that are not among the others
        return np.concatenate([i[ok], begin[back]]), np.concatenate([end[ok], i[back] + 1])

    def counters(self) -> np.ndarray:
        """The counter of each word."""
        return (self.hash % np.uint64(COUNTERS)).astype(np.int64)

    def digests(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the words of each run."""
        s, e = self.first[first], self.first[end]
        return tuple(words.hashes(h, s, e).view(np.int64) for h in (self.hash, words.mixed(self.hash + np.uint64(words.FACTOR))))


def information(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(what a word of each counter tells, in 1/256 bit; the sentences) of all texts. COUNTERS numbers, whatever the corpus."""

    def count(batches):
        words_of, sentences = np.zeros(COUNTERS, np.int64), 0
        for b in slices(batches, 0, 1 << 20):
            found = Sentences(b.column(0).to_pylist())
            words_of += np.bincount(found.counters(), minlength=COUNTERS)
            sentences += len(found.text)
        used = np.flatnonzero(words_of)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(words_of[used], sentences))], names=["counter", "n"])

    rows = map_arrow(docs.select("text"), count, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).collect()
    counts, sentences = np.ones(COUNTERS, np.int64), 0
    for r in rows:
        if r.counter < 0:
            sentences = r.n
        else:
            counts[r.counter] = r.n
    return np.round(BIT * np.log2(max(1, counts.sum()) / counts)).astype(np.int64), sentences


def dedup_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = 0, across: bool = False, chance: float | None = None) -> DataFrame:
    """doc_id, kept_text, n_sentences, n_removed, n_chars_removed for every row of docs.

    Every run of consecutive sentences with min_sentences sentences and min_words words at least counts (lower-cased, white space
    collapsed, hashed to 128 bits). With a `chance`, not the number of words counts but what they tell: words drawn one by one as
    often as all texts have them must be less likely than that to repeat the run in any sentence's place. Of equal runs the one at
    the smallest (doc_id, text hash, position) is first; sentences covered by any other are removed (across: only where two documents
    hold the run). The shortest runs from and up to each sentence are hashed: they cover what longer ones would. A null or empty text has no sentences and keeps its (empty) text. Repeated rows, equal in id and text,
    count as one and lose the same sentences. Rows with a null doc_id keep their text and don't count. An empty table gives an
    empty one. Other columns are ignored. doc_id may be of any type with an order.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("text"))
    counted = rows.where("doc_id is not null").select("doc_id", "row_key", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights, least = None, min_words
    if chance is not None:
        weights, sentences = information(counted)
        least = math.ceil(BIT * math.log2(max(1, sentences) / chance))

    def hashed(batches):
        for b in slices(batches, 2, 1 << 20):
            found = Sentences(b.column(2).to_pylist())
            first, end = found.runs(min_sentences, least, weights)
            h1, h2 = found.digests(first, end)
            which = found.text[first]
            place = pa.array(which)
            yield pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), pa.array((first - found.of_text[which]).astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array(h1), pa.array(h2)], names=["doc_id", "row_key", "first", "n", "h1", "h2"])

    found = map_arrow(counted, hashed, f"doc_id {kind}, row_key bigint, first int, n int, h1 bigint, h2 bigint")
    # only 64 bits of each run are shuffled to find those that repeat at all; the rest of a row follows for these alone
    repeated = cut(found.groupBy("h1").agg(F.count("*").alias("c")).where("c > 1").select("h1"), "span-repeats")
    again = cut(found.join(repeated, "h1", "left_semi"), "span-rows")
    firsts = again.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row_key", "first")).alias("f"), F.max("doc_id").alias("last"), F.count("*").alias("c"))
    firsts = cut(firsts.where(F.col("f.doc_id") < F.col("last") if across else F.col("c") > 1).select("h1", "h2", "f"), "span-firsts")
    later = again.join(firsts, ["h1", "h2"]).where(F.struct("doc_id", "row_key", "first") > F.col("f"))
    gone = cut(later.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("gone")), "span-gone")
    joined = rows.join(gone, ["doc_id", "row_key"], "left").select("doc_id", "text", F.col("gone.first").alias("at"), F.col("gone.n").alias("n"))

    def removed(batches):
        for b in slices(batches, 1, 1 << 20):
            texts = b.column(1).to_pylist()
            found = Sentences(texts)
            kept, lost, chars = list(texts), [0] * len(texts), [0] * len(texts)
            for r in np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                low, high = int(found.of_text[r]), int(found.of_text[r + 1])
                edge = np.zeros(high - low + 1, np.int64)
                at, size = (np.array(b.column(i)[r].as_py(), np.int64) for i in (2, 3))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                drop = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                text, out, last = texts[r], [], 0
                for before, i in zip([-2, *drop.tolist()], drop.tolist()):
                    if i != before + 1:  # what parts two removed sentences goes with them
                        out.append(text[last : found.start[low + i]])
                    last = found.end[low + i]
                kept[r] = "".join([*out, text[last:]])
                lost[r], chars[r] = len(drop), len(text) - len(kept[r])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(np.diff(found.of_text)), pa.array(lost, pa.int64()), pa.array(chars, pa.int64())], names=["doc_id", "kept_text", "n_sentences", "n_removed", "n_chars_removed"])

    return map_arrow(joined, removed, f"doc_id {kind}, kept_text string, n_sentences bigint, n_removed bigint, n_chars_removed bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_spans(table(spark, sf_dir, "documents"), chance=CHANCE)
    return out.select("doc_id", "n_sentences", "n_removed", "n_chars_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))
