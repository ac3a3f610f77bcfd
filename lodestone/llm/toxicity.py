"""Toxicity: a gapped-subsequence string kernel on windows of sentences, Nystrom landmarks and a support vector machine."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import first_by_hash, fold, give_back, joined_bytes, map_arrow, slices, table

#: Subsequences of 4 bytes within 6, weighted by DECAY for each skipped byte, hashed to 2^BITS columns.
SPAN, DECAY, BITS = 6, 0.6, 20
GAPS = [(i, j, k) for i, j, k in itertools.combinations(range(1, SPAN), 3)]
#: A sentence is rated in windows of so many words, and whole where it has fewer.
WIDTHS = (1, 2, 4, 8)
#: The sample: so many documents a label, so many bytes of a text (longer ones are not learned from) and of all of a label.
PER_LABEL, TEXT_BYTES, LABEL_BYTES = 1500, 64 << 10, 8 << 20
LANDMARKS, ROUNDS = 800, 3
#: Texts that are taken apart at a time when learning, and bytes of them (a longer one stays whole): the memory that learning takes follows these.
BATCH_TEXTS, BATCH_BYTES, STRETCH = 256, 1 << 20, 1 << 16
#: Random windows of clean texts for each toxic text, and in all at most, beside the highest rated of each width.
EASY, MOST_EASY = 8, 3000
#: Weights are whole numbers up to this, so that sums don't depend on their order.
WHOLE = 1 << 22
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_KIND = np.ones(256, np.uint8)  # 0 blank, 1 letter (bytes of other scripts too), 2 end of a sentence, 3 other ASCII
_KIND[:128] = 3
_KIND[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123))] = 1
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[[10, 33, 46, 63]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of texts: bytes with one blank before each word and one at each text's end; of word i the blank's place at[i], its
    sentence (numbered through) and text. at has one more entry for each text's last blank, which `last` leads to: word i ends
    before after[i]."""

    data: np.ndarray
    at: np.ndarray
    after: np.ndarray
    sentence: np.ndarray
    text: np.ndarray

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end, text) of each run of `width` words in a sentence; a sentence with fewer words is one. Both blanks belong to it."""
        n = len(self.at)
        i = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = self.sentence[1:] != self.sentence[:-1]
        first = np.maximum.accumulate(np.where(new, i, 0))
        end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]  # the word after the sentence
        ok = (i + width <= end) | (i == first)
        return self.at[ok], self.after[np.minimum(i + width, end)[ok] - 1] + 1, self.text[ok]


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    """The words of texts that lie end to end in data.

    A-Z are lower-cased; other ASCII signs between two letters are taken out ("i.d.i.o.t"), elsewhere they part words. Three or
    more words of one letter after each other in a line are one word ("i d i o t", "i - d - i").
    """
    kind = _KIND[data]
    letter = kind == 1
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = np.ones(len(data), bool)
    edge = at[1:-1]
    same[edge[edge < len(data)]] = False  # first byte of a text
    near = np.zeros(len(data), bool)
    if len(data) > 2:
        near[1:-1] = letter[:-2] & letter[2:] & same[1:-1] & same[2:]
    keep = ~((kind >= 2) & (data != 10) & near)
    data, kind, text, letter, same = _LOWER[data[keep]], kind[keep], text[keep], letter[keep], None
    if not letter.any():
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, none, none)
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1] & (text[1:] == text[:-1])
    starts = np.flatnonzero(letter & ~before)
    letters = np.flatnonzero(letter)
    word = np.cumsum(letter & ~before)[letters] - 1  # of each letter byte
    heads = np.bincount(word, (data[letters] & 0xC0) != 0x80, len(starts))  # letters of each word, however many bytes each has
    ends_seen, lines_seen = np.cumsum(kind == 2), np.cumsum(data == 10)
    owner, line, sentence = text[starts], lines_seen[starts], ends_seen[starts]
    lone = heads <= 1
    chain = np.zeros(len(starts), bool)  # goes on with a lone letter's run
    chain[1:] = lone[1:] & lone[:-1] & (owner[1:] == owner[:-1]) & (line[1:] == line[:-1])
    begin = np.flatnonzero(~chain)
    size = np.diff(np.append(begin, len(starts)))
    head = ~chain | np.repeat(size < 3, size)  # which words stay words
    new_text = np.ones(len(starts), bool)
    new_text[1:] = owner[1:] != owner[:-1]
    # one blank before each word and one more at each text's end
    blanks = np.cumsum(head) + np.cumsum(new_text) - 1
    out = np.full(len(letters) + int(head.sum() + new_text.sum()), 32, np.uint8)
    place = np.arange(len(letters)) + blanks[word]
    out[place] = data[letters]
    first = place[np.searchsorted(letters, starts[head])] - 1
    owner, sentence = owner[head], np.cumsum(np.concatenate([[True], (sentence[head][1:] != sentence[head][:-1]) | (owner[head][1:] != owner[head][:-1])]))
    final = np.append(owner[1:] != owner[:-1], True)
    after = np.append(first[1:], len(out)) - final
    return Words(out, first.astype(np.int64), after.astype(np.int64), sentence, owner)


def columns(data: np.ndarray):
    """(hashed column of the subsequence from each byte, its last byte's distance) for every pattern of gaps."""
    parts = [data.astype(np.uint32) * f for f in _FACTORS]
    n = len(data) - SPAN + 1
    for i, j, k in GAPS:
        h = parts[0][:n] + parts[1][i : i + n] + parts[2][j : j + n] + parts[3][k : k + n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield (h >> np.uint32(32 - BITS)).astype(np.int32), k


def running(data: np.ndarray, weights: np.ndarray) -> dict[int, np.ndarray]:
    """By the last byte's distance k, the running sums of whole weights over the subsequences that start before each byte."""
    out = {k: np.zeros(len(data) + 1, np.int64) for k in range(3, SPAN)}
    wide = np.concatenate([data, np.full(SPAN - 1, 32, np.uint8)])
    for i in range(0, len(data), STRETCH):
        for column, k in columns(wide[i : i + STRETCH + SPAN - 1]):
            out[k][i + 1 : i + 1 + len(column)] += weights[column]
    for sums in out.values():
        np.cumsum(sums, out=sums)
    return out


def rate(sums: dict[int, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The weighted sum over the subsequences that lie in each window [start, end), divided by the root of its length."""
    total = np.zeros(len(start))
    for k, s in sums.items():
        total += DECAY ** (k - 3) * (s[np.maximum(start, end - k)] - s[start])
    return total / np.sqrt(end - start)


def vectors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, float32 values) of each window's feature vector, of unit length (all zero for a window too short for a subsequence)."""
    size = ends - starts
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(int(size.sum())) - begin[row]
    own = np.concatenate([data[starts[row] + place], np.full(SPAN - 1, 32, np.uint8)])
    keys, values = [], []
    for column, k in columns(own):
        inside = place + k < size[row]
        keys.append((row[inside] << BITS) | column[inside])
        values.append(np.full(len(keys[-1]), DECAY ** (k - 3)))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(back, np.concatenate(values), len(key))
    cuts = np.searchsorted(key >> BITS, np.arange(len(size) + 1))
    column = (key & ((1 << BITS) - 1)).astype(np.int32)
    return [(column[s:e].copy(), ((v := value[s:e]) / np.sqrt(max(1e-9, (v * v).sum()))).astype(np.float32)) for s, e in zip(cuts.tolist(), cuts[1:].tolist())]


def gram(x: list, y: list, block: int = 200, rows: int = 128) -> np.ndarray:
    """The kernel between two lists of vectors: a block of the second list at a time as a dense matrix of the columns that some rows of the first have."""
    out = np.zeros((len(x), len(y)), np.float32)
    place = np.zeros(1 << BITS, np.int32)
    for k in range(0, len(y), block):
        part = y[k : k + block]
        column, value, owner = (np.concatenate(a) for a in zip(*[(c, v, np.full(len(c), j, np.int32)) for j, (c, v) in enumerate(part)]))
        for i in range(0, len(x), rows):
            some = x[i : i + rows]
            place[column] = 1
            used = np.unique(np.concatenate([c[place[c] > 0] for c, _ in some]))
            place[column] = 0
            place[used] = np.arange(1, len(used) + 1)  # 0 for columns that the block or the rows lack
            dense = np.zeros((len(used) + 1, len(part)), np.float32)
            inside = np.flatnonzero(place[column])
            dense[place[column[inside]], owner[inside]] = value[inside]
            for r, (c, v) in enumerate(some, i):
                p = place[c]
                hit = np.flatnonzero(p)
                out[r, k : k + block] = v[hit] @ dense[p[hit]]
            place[used] = 0
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 60, block: int = 1024) -> np.ndarray:
    """Weights of a squared-hinge linear machine, by Newton steps on the margin's violators; the last column of x is all ones, for
    the offset. x may be of half precision: it is read in blocks."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    balance = np.where(y > 0, 1.0, max(1e-9, (y > 0).sum() / max(1, (y < 0).sum())))
    active = None
    for _ in range(steps):
        now, square, right = np.zeros(len(y), bool), np.zeros_like(penalty), np.zeros_like(w)
        for i in range(0, len(y), block):
            rows, side = x[i : i + block].astype(np.float32), y[i : i + block]
            hit = side * (rows @ w) < 1
            now[i : i + block] = hit
            root = np.sqrt(balance[i : i + block][hit]).astype(np.float32)
            rows = rows[hit] * root[:, None]
            square += rows.T @ rows
            right += rows.T @ (root * side[hit])
        if active is not None and (now == active).all():
            break
        active = now
        w = np.linalg.solve(penalty + cost * square, cost * right)
    return w


@dataclass
class Model:
    """Whole weights of the hashed subsequences, slope and offset of the logistic, and what a text without words is rated."""

    weights: np.ndarray
    slope: float
    offset: float
    least: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score for each text, from its own bytes alone: sums are of whole numbers, so neither the batch nor its order matters."""
        high = highest(words_of(*joined_bytes(texts)), self.weights, len(texts), self.least)
        return 1 / (1 + np.exp(-np.clip(self.slope * high + self.offset, -30, 30)))


def highest(found: Words, weights: np.ndarray, texts: int, least: float) -> np.ndarray:
    """The rate of each text's highest window; `least` for texts without words."""
    high = np.full(texts, -np.inf)
    if len(found.at):
        sums = running(found.data, weights)
        for width in WIDTHS:
            s, e, text = found.windows(width)
            rated = rate(sums, s, e)
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            high[text[first]] = np.maximum(high[text[first]], np.maximum.reduceat(rated, first))
    return np.where(np.isfinite(high), high, least)


def whole(weights: np.ndarray) -> np.ndarray:
    return np.rint(weights * (WHOLE / max(1e-9, float(np.abs(weights).max())))).astype(np.int32)


def constant(score: float) -> Model:
    """A model that gives every text the same score."""
    return Model(np.zeros(1 << BITS, np.int32), 0.0, float(np.log(score / (1 - score))), 0.0)


def batches_of(texts: list[str], labels: np.ndarray) -> list[tuple[Words, np.ndarray]]:
    """(words, labels) of bounded pieces of the texts. Words are found by a few texts at a time, as finding them takes many times the bytes."""
    out, i = [], 0
    while i < len(texts):
        start, held, parts, part, part_bytes = i, 0, [], [], 0
        while i < len(texts) and i - start < BATCH_TEXTS:
            raw = texts[i].encode("utf-8", "replace")
            if held and held + len(raw) > BATCH_BYTES:
                break
            if part and part_bytes + len(raw) > STRETCH:
                parts.append((i - len(part), words_of(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))))
                part, part_bytes = [], 0
            part.append(raw)
            held, part_bytes, i = held + len(raw), part_bytes + len(raw), i + 1
        parts.append((i - len(part), words_of(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))))
        out.append((end_to_end([(first - start, found) for first, found in parts]), labels[start:i]))
    return out


def end_to_end(parts: list[tuple[int, Words]]) -> Words:
    """One Words of several, each with the number of its first text; in 4-byte numbers."""
    base = np.cumsum([0, *(len(found.data) for _, found in parts)])
    sentences = np.cumsum([0, *(int(found.sentence[-1]) if len(found.at) else 0 for _, found in parts)])
    join = lambda arrays: np.concatenate([a.astype(np.int32) for a in arrays])
    return Words(
        np.concatenate([found.data for _, found in parts]), join(found.at + b for (_, found), b in zip(parts, base)), join(found.after + b for (_, found), b in zip(parts, base)),
        join(found.sentence + s for (_, found), s in zip(parts, sentences)), join(found.text + first for first, found in parts),
    )


def first_weights(batches: list[tuple[Words, np.ndarray]]) -> np.ndarray:
    """Log odds of the texts that hold each subsequence, 0 for those of fewer than four texts."""
    counts, last, size = np.zeros((2, 1 << BITS), np.float32), np.zeros(1 << BITS, np.int32), np.zeros(2)
    for found, label in batches:
        size += np.bincount(label, minlength=2)
        first = np.flatnonzero(np.concatenate([[True], found.text[1:] != found.text[:-1]])) if len(found.at) else []
        for s, e in zip(first, [*first[1:], len(found.at)]):
            own = found.data[found.at[s] : found.after[e - 1] + 1]
            held = np.concatenate([c[: max(0, len(own) - k)] for c, k in columns(np.concatenate([own, np.full(SPAN - 1, 32, np.uint8)]))])
            place = np.arange(len(held), dtype=np.int32)
            last[held] = place
            counts[label[found.text[s]], held[last[held] == place]] += 1  # each once
    odds = np.log((counts[1] + 1) / (size[1] + 2)) - np.log((counts[0] + 1) / (size[0] + 2))
    odds[counts.sum(0) < 4] = 0
    return odds.astype(np.float32)


def distorted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows end to end, each with one random letter put in somewhere between its own: (bytes, starts, ends)."""
    parts = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        at = int(rng.integers(min(s + 2, e - 1), max(s + 3, e - 1)))
        parts.append(np.concatenate([data[s:at], [np.uint8(97 + rng.integers(26))], data[at:e]]).astype(np.uint8))
    size = np.array([len(p) for p in parts], np.int64)
    return np.concatenate([*parts, np.zeros(0, np.uint8)]), np.cumsum(size) - size, np.cumsum(size)


def best(rated: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The place of each text's highest rate, the first of equal ones; windows are in the order of their texts."""
    new = np.concatenate([[True], text[1:] != text[:-1]])
    high = np.maximum.reduceat(rated, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.flatnonzero(rated == high)
    return hit[np.concatenate([[True], text[hit][1:] != text[hit][:-1]])]


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """The machine, folded into weights of the hashed subsequences, and the logistic that turns a text's highest window into a score.

    A text's label holds for the text, not for each of its sentences. So the windows that count as toxic are first those of toxic
    texts with the highest log odds, then those that the machine itself rates highest; each counts once more with a random letter
    put in. Clean texts give their highest window of every width, and others at random.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return constant(0.9999 if len(y) and y.max() == 1 else 0.0001)
    batches = batches_of(texts, y)
    plenty = sum(int((label[found.text] == 0).sum()) for found, label in batches) * len(WIDTHS)
    share = min(1.0, min(MOST_EASY, EASY * int(y.sum())) / max(1, plenty))
    weights = whole(first_weights(batches))
    give_back()
    for turn in range(ROUNDS):
        rng = np.random.default_rng(seed + turn)
        bad, good, spoilt = [], [], []
        for found, label in batches:
            if not len(found.at):
                continue
            sums, tops = running(found.data, weights), []
            for width in WIDTHS:
                s, e, text = found.windows(width)
                rated, clean = rate(sums, s, e), label[text] == 0
                top = best(rated, text)
                tops.append((rated[top], s[top], e[top], text[top]))
                pick = np.union1d(top[clean[top]], np.flatnonzero(clean & (rng.random(len(s)) < share)))
                good += vectors(found.data, s[pick], e[pick])
            rated, s, e = (np.stack([t[k] for t in tops]) for k in range(3))  # every text has windows of every width
            toxic = np.flatnonzero(label[tops[0][3]] == 1)
            width = rated[:, toxic].argmax(0)
            s, e = s[width, toxic], e[width, toxic]
            bad += vectors(found.data, s, e)
            other = distorted(found.data, s, e, rng)
            bad += vectors(*other)
            spoilt.append(other)
            del sums  # else the next piece's are made beside it
        if not good or not bad:
            return constant(float((y.sum() + 1) / (len(y) + 2)))
        marks = [bad[i] for i in rng.permutation(len(bad))[: LANDMARKS // 2]] + [good[i] for i in rng.permutation(len(good))[: LANDMARKS // 2]]
        values, basis = np.linalg.eigh(gram(marks, marks).astype(np.float64))
        use = values > 1e-6
        root = (basis[:, use] / np.sqrt(values[use])).astype(np.float32)
        root = np.hstack([root, np.zeros((len(root), 1), np.float32)])  # the offset's column comes with the product
        side = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
        features = np.empty((len(side), root.shape[1]), np.float16)
        every = [*bad, *good]
        del bad, good, basis
        give_back()
        for i in range(0, len(side), 1024):
            features[i : i + 1024] = gram(every[i : i + 1024], marks) @ root
            every[i : i + 1024] = [None] * len(every[i : i + 1024])  # a window's vector goes when its features are there
        features[:, -1] = 1
        w = svm(features, side)
        del features, every
        beta = root[:, :-1] @ w[:-1]
        folded = np.zeros(1 << BITS, np.float32)
        for b, (c, v) in zip(beta, marks):
            folded[c] += np.float32(b) * v
        weights = whole(folded)
        give_back()
    high = np.concatenate([highest(found, weights, len(label), np.nan) for found, label in batches])
    least = float(np.nanmin(high))
    again = np.concatenate([rate(running(data, weights), s, e) for data, s, e in spoilt])
    slope, offset = platt(np.concatenate([np.where(np.isnan(high), least, high), again]), np.concatenate([y, np.ones(len(again))]))
    return Model(weights, slope, offset, least)


def platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, by damped Newton steps."""
    scale = max(1e-9, float(np.abs(score).max()))
    x = np.stack([score / scale, np.ones(len(score))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (label - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def sample_rows(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame | None:
    """place (from 0), toxic and text of a bounded sample by hash, None where it is empty: per_label documents of each label at most, of TEXT_BYTES at most each
    and LABEL_BYTES together, never from the held-out fold. The same rows give the same sample, whatever their order."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    ids = first_by_hash(known.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), "toxic", "doc_id", per_label).select("doc_id", "toxic").collect()
    if not ids:
        return None
    wanted = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], f"doc_id {kind}, toxic int"))  # 2 * per_label rows
    usable = docs.select("doc_id", "text", F.octet_length("text").alias("size")).where(F.col("size") <= TEXT_BYTES).join(wanted, "doc_id").withColumn("row_key", F.xxhash64("doc_id", "text"))
    sizes = usable.groupBy("row_key", "toxic").agg(F.min("size").alias("size"))
    sizes = first_by_hash(sizes, "toxic", "row_key", per_label).select("row_key", "toxic", "size", "rank").collect()
    picked, used = [], {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: (r["rank"], r.toxic)):
        used[r.toxic] += r.size
        if used[r.toxic] <= LABEL_BYTES:
            picked.append((r.row_key, r.toxic, len(picked)))
    if not picked:
        return None
    place = F.broadcast(spark.createDataFrame(picked, "row_key bigint, toxic int, place int"))  # 2 * per_label rows
    return usable.select("row_key", "toxic", "text").join(place, ["row_key", "toxic"]).groupBy("place", "toxic").agg(F.min("text").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> list[tuple[str, int]]:
    """(text, label) of the sample, in its order."""
    rows = sample_rows(docs, labels, per_label)
    return [] if rows is None else [(r.text, r.toxic) for r in sorted(rows.collect(), key=lambda r: r.place)]


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from the texts of a bounded sample (see `sample_rows`). Texts of TEXT_BYTES at most are learned from; all are scored whole.

    The sample, bounded whatever the input, is learned from in an executor's task; the driver gets the weights alone.
    """
    rows = sample_rows(docs, labels, per_label)
    if rows is None:
        return train([], [])

    def learn(batches):
        drawn = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        model = train([text for _, _, text in drawn], [label for _, label, _ in drawn])
        values = [[model.weights.tobytes()], [model.slope], [model.offset], [model.least]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["weights", "slope", "offset", "least"])

    found = map_arrow(rows.select("place", "toxic", "text").coalesce(1), learn, "weights binary, slope double, offset double, least double").first()
    return Model(np.frombuffer(bytes(found.weights), np.int32), found.slope, found.offset, found.least)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row, from the whole text alone: the logistic of the text's highest window.

    Windows are runs of 1, 2, 4 and 8 words within a sentence, and shorter sentences whole; subsequences cross the blanks in them.
    A null text, or one without letters or digits, scores like the least toxic text learned from. Equal texts get equal scores,
    whatever else is in the table; repeated rows are scored each. doc_id may be of any type. An empty table gives an empty one.
    Other columns are ignored. Where one label or none was learned from, every text has the same score.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in slices(batches, 1, 1 << 19):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under the threshold. Rated where they lie: no join, no shuffle."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def filtered(batches):
        for b in slices(batches, at, 1 << 19):
            yield b.filter(pa.array(shared.value.scores(b.column(at)) < threshold))

    return map_arrow(docs, filtered, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
