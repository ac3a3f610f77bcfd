"""Language ID: a blended-spectrum presence kernel with Nystrom landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import words
from lodestone.llm.common import first_by_hash, fold, give_back, joined_bytes, map_arrow, slices, table

#: n-grams of 1 to 4 bytes, each length hashed to so many columns.
LENGTHS, BITS = (1, 2, 3, 4), 13
COLUMNS = 256 + len(LENGTHS[1:]) * (1 << BITS)
PER_LANGUAGE, MOST_SAMPLES, LANDMARKS, RIDGE = 300, 3000, 384, 1e-3
_LETTER = regex.compile(r"\p{L}")
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[:65] = _FOLDED[91:97] = _FOLDED[123:128] = 32
_FOLDED[65:91] += 32


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A (texts, COLUMNS) matrix of 0 and 1: which n-grams of the whole text (letters lower-cased, other ASCII one blank) occur."""
    n = len(at) - 1
    data = _FOLDED[data]
    seen = np.zeros(n * COLUMNS + 1, np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int64) * COLUMNS, np.diff(at))
    code, start = np.zeros(len(data), np.uint64), 0
    for k in LENGTHS:
        if len(data) < k:
            break
        code = (code[: len(data) - k + 1] << np.uint64(8)) | data[k - 1 :]
        column = code.astype(np.int64) if k == 1 else ((words.mixed(code + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64) + start)
        start = 256 if k == 1 else start + (1 << BITS)
        where = row[: len(code)] + column
        for j in range(1, k):  # grams that would run into the next text
            cross = at[1:] - j
            cross = cross[(cross >= at[:-1]) & (cross < len(where))]
            where[cross] = n * COLUMNS
        seen[where] = 1
    return seen[:-1].reshape(n, COLUMNS)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared n-grams, normalised so that equal sets give 1."""
    other = y.astype(np.float32)
    size = np.maximum(1, other.sum(1))
    out = np.zeros((len(x), len(y)), np.float32)
    for i in range(0, len(x), 128):  # a block of rows as floats at a time
        rows = x[i : i + 128].astype(np.float32)
        out[i : i + 128] = (rows @ other.T) / np.sqrt(np.maximum(1, rows.sum(1))[:, None] * size[None, :])
    return out


def train(samples: np.ndarray, labels: list[str], seed: int = 5) -> tuple[list[str], np.ndarray]:
    """The sorted languages, and the weights that give every language's ridge regression from a presence row.

    With landmarks L, Nystrom features are k(x, L) M for M = k(L, L)^(-1/2); the regression on them is again linear in k(x, L),
    and k(x, L) is linear in the presence row up to x's own norm, so all is folded into one matrix.
    """
    names = sorted(set(labels))
    if not names:
        return [], np.zeros((COLUMNS, 0), np.float32)
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    order = np.random.default_rng(seed).permutation(len(labels))
    marks = samples[order[:LANDMARKS]]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel(samples, marks).astype(np.float64) @ root
    solved = np.linalg.solve(features.T @ features + RIDGE * len(labels) * np.eye(features.shape[1]), features.T @ y)
    marks = marks.astype(np.float32)
    weights = (marks / np.sqrt(np.maximum(1, marks.sum(1)))[:, None]).T @ (root @ solved).astype(np.float32)
    return names, weights


def sample_ids(docs: DataFrame, per_label: int = PER_LANGUAGE, most: int = MOST_SAMPLES) -> DataFrame:
    """Ids and languages to learn from: by hash, per_label of each language at most and `most` in all, never from the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "lang")
    return first_by_hash(known, "lang", "doc_id", per_label).groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("rank").alias("rank")).orderBy("rank", "lang", "doc_id").limit(most).select("doc_id", "lang")


def fit(docs: DataFrame, per_label: int = PER_LANGUAGE, most: int = MOST_SAMPLES) -> tuple[list[str], np.ndarray]:
    """Learn from the text and lang of a bounded sample of the training folds."""
    ids, kind = sample_ids(docs, per_label, most).collect(), docs.schema["doc_id"].dataType.simpleString()
    if not ids:
        return train(np.zeros((0, COLUMNS), np.uint8), [])
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r.lang) for r in ids], f"doc_id {kind}, label string"))  # `most` rows

    def features(batches):
        for b in slices(batches, 1, 1 << 20):
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                bits = np.packbits(presence(*joined_bytes(part.column(1))), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x.tobytes() for x in bits], pa.binary())], names=["doc_id", "label", "bits"])

    # rows with equal ids: the first text by hash counts, so that the sample is the same for any order of rows
    rows = docs.where("text is not null").join(wanted, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = map_arrow(rows.select("doc_id", "text", "label"), features, f"doc_id {kind}, label string, bits binary").collect()  # `most` rows of COLUMNS bits
    rows.sort(key=lambda r: (r.doc_id, bytes(r.bits)))  # the same rows give the same model
    packed = np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1)
    model = train(np.unpackbits(packed, axis=1, count=COLUMNS), [r.label for r in rows])
    give_back()
    return model


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for every row, from the whole text alone.

    A null text, or one without a letter, is `und` with score 0; so is every text when nothing could be learned. Other columns
    are ignored. Ties go to the first language in code point order. Repeated rows are each predicted, alike. An empty table gives
    an empty one. doc_id may be of any type.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        names, weights = shared.value
        for b in slices(batches, 1, 1 << 20):
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                data, at = joined_bytes(part.column(1))
                rows = presence(data, at).astype(np.float32)
                raw = rows @ weights / np.sqrt(np.maximum(1, rows.sum(1)))[:, None]
                texts = part.column(1).to_pylist()
                lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
                if names:
                    best = raw.argmax(1)
                    odds = np.exp(4 * (raw - raw.max(1, keepdims=True)))
                    score = np.where(lettered, 1 / odds.sum(1), 0.0)
                    said = [names[k] if ok else "und" for k, ok in zip(best, lettered)]
                else:
                    score, said = np.zeros(part.num_rows), ["und"] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), predict, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
