"""Token-ID output: Parquet list columns with dictionary or delta encoding, controlled row groups and page indexes."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import words
from lodestone.llm.common import joined_bytes, map_arrow, scratch, slices, table

TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers; it forgets all of them beyond this.
CACHE_WORDS, TABLE_BITS = 700_000, 21
_workers: dict[str, WordIds] = {}


#: The normaliser and pre-tokenizer that a text's pieces may be encoded apart under.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class WordIds:
    """Ids of whole texts from the ids of their pieces, which a worker remembers by hash and bytes.

    A tokenizer with the normaliser and pre-tokenizer above never joins across ASCII white space and drops it, and never joins a
    letter with the full stop or comma after it, so a text's ids are those of its pieces end to end. Under any other whole texts
    are encoded. Forgetting changes speed, never ids; nor do two pieces of one hash, as their bytes are compared.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        added = all(x["content"].startswith("<|") and x["special"] and not x["normalized"] for x in config["added_tokens"])
        self.by_piece = added and config["normalizer"] == NORMALIZER and config["pre_tokenizer"] == PRE_TOKENIZER and config["model"].get("end_of_word_suffix") == "</w>"
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.reset()

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def reset(self) -> None:
        self.table, self.pool = words.Table(TABLE_BITS), np.zeros(1 << 20, np.int32)
        self.first, self.size, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.letters, self.letters_first, self.letters_size, self.letters_used = np.zeros(1 << 22, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each text), by the tokenizer alone."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def other(self, entry: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which pieces of data are not, byte for byte, those of their entries."""
        size = ends - starts
        wrong = self.letters_size[entry] != size
        same = np.flatnonzero(~wrong)
        size = size[same]
        ahead = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        unlike = data[step + np.repeat(starts[same] - ahead, size)] != self.letters[step + np.repeat(self.letters_first[entry[same]] - ahead, size)]
        if unlike.any():
            wrong[same[np.unique(np.searchsorted(ahead, np.flatnonzero(unlike), "right") - 1)]] = True
        return np.flatnonzero(wrong)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each text) of texts that lie end to end in data."""
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        if not self.by_piece:
            raw = data.tobytes()
            return self.whole([raw[s:e].decode("utf-8", "replace") for s, e in zip(at.tolist(), at[1:].tolist())])
        if not ((data[:-1] == 60) & (data[1:] == 124)).any():  # "<|" may start a special token, which keeps its case
            data = words.lower_ascii(data)
        letter = np.zeros(len(data) + 2, bool)
        letter[1:-1] = (data >= 97) & (data <= 122)
        open_after = np.ones(len(data) + 1, bool)
        open_after[: len(data)] = words._SPACE[data]
        open_after[at[1:]] = True
        apart = np.flatnonzero(((data == 44) | (data == 46)) & letter[: len(data)] & open_after[1:])
        apart = apart[~np.isin(apart, at, assume_unique=False)] if len(apart) else apart
        starts, ends, per_text = words.bounds(data, at, apart)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        h = words.hashes(data, starts, ends)
        if self.table.count > CACHE_WORDS:
            self.reset()
        entry = self.table.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            raw = data.tobytes()
            picked = missing[one]
            places = list(zip(starts[picked].tolist(), ends[picked].tolist()))
            self.learn(new, [raw[s:e].decode("utf-8", "replace") for s, e in places], [data[s:e] for s, e in places])
            entry[missing] = self.table.find(new)[back]
        wrong = self.other(entry, data, starts, ends)
        if len(wrong):  # pieces of one hash and other bytes: each such text is encoded whole
            raw = data.tobytes()
            return self.whole([raw[s:e].decode("utf-8", "replace") for s, e in zip(at.tolist(), at[1:].tolist())])
        size = self.size[entry].astype(np.int64)
        done = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.first[entry] - done[:-1], size) + np.arange(done[-1])]
        return ids, np.diff(done[per_text])

    def learn(self, keys: np.ndarray, texts: list[str], pieces: list[np.ndarray]) -> None:
        alpha = np.array([t.isalpha() for t in texts])
        plain = [t for t, a in zip(texts, alpha) if a]
        sizes = np.zeros(len(texts), np.int64)
        joined = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int32)
        stops = np.flatnonzero(self.closing[joined]) + 1
        if len(stops) == len(plain):  # each of them is one piece, whose last id closes a word
            sizes[alpha] = np.diff(stops, prepend=0)
        else:
            alpha[:] = False
            joined = joined[:0]
        odd = [e.ids for e in self.tokenizer.encode_batch_fast([t for t, a in zip(texts, alpha) if not a], add_special_tokens=False)]
        sizes[~alpha] = [len(x) for x in odd]
        flat = np.concatenate([joined, np.array([i for x in odd for i in x], np.int32)])
        first = np.zeros(len(texts), np.int64)
        for group, base in ((alpha, 0), (~alpha, len(joined))):
            first[group] = base + np.cumsum(sizes[group]) - sizes[group]
        values = self.table.add(keys)
        if self.table.count > len(self.first):
            grow = max(2 * len(self.first), self.table.count)
            self.first, self.size, self.letters_first, self.letters_size = (np.concatenate([x, np.zeros(grow - len(x), x.dtype)]) for x in (self.first, self.size, self.letters_first, self.letters_size))
        raw = np.concatenate(pieces)
        if self.letters_used + len(raw) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(max(len(self.letters), len(raw)), np.uint8)])
        size = np.array([len(p) for p in pieces], np.int64)
        self.letters_first[values], self.letters_size[values] = self.letters_used + np.cumsum(size) - size, size
        self.letters[self.letters_used : self.letters_used + len(raw)] = raw
        self.letters_used += len(raw)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.int32)])
        self.first[values], self.size[values] = first + self.used, sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 1, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode every whole text (null: empty) and write (part, doc_id, local_start, n_tokens, ids) to Parquet in ascending doc_id order.

    One range shuffle of the texts, then tokens go straight from the Arrow batches to Spark's Parquet writer (task commit makes
    a retried task harmless). encoding is "dictionary" (RLE ids) or "delta" (DELTA_BINARY_PACKED, Parquet v2). Page indexes are
    always written. Null ids come first; rows with equal ids follow the hash of their text. An empty table gives an empty one.
    Other columns are ignored. doc_id may be of any type with an order.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known, part, start = WordIds.of(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in slices(batches, 1, 1 << 20):
            data, at = joined_bytes(b.column(1))
            ids, n = known.encode(data, at)
            ids = np.insert(ids, np.cumsum(n), np.int32(end_id))
            n = n + 1
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), b.column(0), pa.array(starts), pa.array(n), lists], names=["part", "doc_id", "local_start", "n_tokens", "ids"])

    delta = encoding == "delta"
    writer = map_arrow(rows, encode, f"part int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, local_start bigint, n_tokens bigint, ids array<int>").write
    writer.options(**{"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.enable.dictionary": str(not delta).lower(), "parquet.writer.version": "PARQUET_2_0" if delta else "PARQUET_1_0", "compression": "zstd"}).parquet(out)


def read_tokens(spark: SparkSession, out: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The written tokens with `start`, the ids of all documents before. Only the asked columns are read; filters on doc_id reach the page indexes."""
    spark.sparkContext  # a session is needed before the schema is read
    data = spark.read.parquet(out)
    totals = data.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row per written file
    before, rows = 0, []
    for t in totals:
        rows.append((t["part"], before))
        before += t["n"]
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, before bigint"))
    return data.join(offsets, "part").withColumn("start", F.col("before") + F.col("local_start")).select(*columns)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of read_tokens' rows."""

    def digest(batches):
        for b in batches:
            lists = b.column(3)
            at = lists.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return map_arrow(tokens.select("doc_id", "start", "n_tokens", "ids"), digest, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents and give the digests of what is read back."""
    spark = docs.sparkSession
    out = scratch(spark, "tokens")
    write_tokens(docs, out, path or tokenizer_path())
    return token_digests(read_tokens(spark, out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
