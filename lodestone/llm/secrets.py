"""Secret scans: patterns of known forms, and Shannon entropy of sliding windows over candidate strings.

A candidate is a longest run of a character class. Its windows' entropies follow from counts that are kept as the window moves by one
character: n log2 n of the character that leaves and of the one that enters, in integers of fixed point, so sums are exact. Windows
over the class's limit join to spans. What an allow-list says of the whole candidate, and what a pattern covers, is left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, slices, table

#: The words before an assigned secret, in either case, and the patterns of the base kinds in their order.
WORDS = ("password", "passwd", "secret", "token", "api_?key")
_either = lambda word: re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)
ASSIGN = f"({'|'.join(map(_either, WORDS))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Longest runs; those that are shorter hold no longer one.
HEX = f"[0-9a-f]{{{LEAST_HEX},}}"
BASE = ("assign", "access", "hex")
#: One bit of entropy in the integers that sums are kept in.
BIT = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """Runs of these characters are candidates; windows of `window` characters count from `bits` bits a character on."""

    kind: str
    characters: str
    window: int
    bits: float

    def limit(self) -> int:
        """The largest sum of n log2 n over a window's characters that counts."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * BIT)


#: Random hexadecimal digits have 3.5 bits on average in 24 characters, random base-64 4.2, words with hyphens 3.6.
CLASSES = (CharacterClass("entropy_hex", "0-9A-Fa-f", 24, 3.2), CharacterClass("entropy_base64", "A-Za-z0-9+/=_-", 24, 4.0))
_WORD = "(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)"
#: Candidates that are no secrets: plain, capitalised, camel-case or upper-case words that signs join, numbers and dates, UUIDs, runs of the alphabet.
ALLOWED = (
    f"{_WORD}(?:[-_/=+]+{_WORD})*",
    "[0-9]+(?:[-_/=+]+[0-9]+)*",
    "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    ".*(?:0123456789|abcdefghij|ABCDEFGHIJ).*",
)


def step_table(window: int) -> np.ndarray:
    """n log2 n in fixed point for counts of 0 to window."""
    return np.array([0] + [round(n * math.log2(n) * BIT) for n in range(1, window + 1)], np.int64)


def entropy_sums(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums of n log2 n of the window that ends at each character, place of the character in its string, string), for all strings
    end to end. Windows that begin before the string hold what there is."""
    size = np.array([len(s) for s in strings], np.int64)
    codes, string = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64), np.repeat(np.arange(len(strings)), size)
    n = len(codes)
    place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    wide = n + window + 1
    at = (string * 256 + codes) * wide + np.arange(n)  # by string, character and place
    order = np.argsort(at, kind="stable")
    among, rank = at[order], np.empty(n, np.int64)
    rank[order] = np.arange(n)
    step = step_table(window)
    enters = rank - np.searchsorted(among, np.maximum(at - window + 1, (string * 256 + codes) * wide))  # as many equal ones are in the window already
    change = step[enters + 1] - step[enters]
    old = np.flatnonzero(place >= window) - window
    leaves = np.searchsorted(among, at[old] + window) - rank[old]  # as many are there before one leaves
    # the entering one was counted without the one that leaves, and the leaving one without the one that enters
    change[old + window] += step[leaves - 1] - step[leaves]
    total = np.cumsum(change)
    begin = np.cumsum(size) - size
    before = np.where(begin > 0, total[np.maximum(begin - 1, 0)], 0)
    return total - np.repeat(before, size), place, string


def entropy_spans(strings: list[bytes], kind: CharacterClass) -> list[tuple[int, int, int]]:
    """(string, start, end) of the joined windows that reach the class's limit."""
    if not strings:
        return []
    sums, place, string = entropy_sums(strings, kind.window)
    hit = np.flatnonzero((place >= kind.window - 1) & (sums <= kind.limit()))
    if not len(hit):
        return []
    fresh = np.append(True, (np.diff(hit) > kind.window) | (np.diff(string[hit]) > 0))
    first, last = hit[fresh], hit[np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)]
    return list(zip(string[first].tolist(), (place[first] - kind.window + 1).tolist(), (place[last] + 1).tolist()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, kinds as numbers in their order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start and then kind, for every row of docs.

    Kinds are assign, access and hex, then the classes in their order. Places are code points, end exclusive. Matches of a base kind
    don't overlap, the leftmost first; those too short are dropped as they are met. Candidates are the longest runs of a class's
    characters; those that an allowed pattern matches as a whole are left out, and spans inside one of a base kind too. A null or empty text
    has no spans. Every row is judged alone: repeated rows and null or repeated ids make no difference. An empty table gives an empty
    one. doc_id may be of any type. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [*BASE, *[c.kind for c in classes]]
    runs = [re.compile(f"[{c.characters}]{{{c.window},}}") for c in classes]
    fine = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else re.compile(r"(?!)")

    def find(batches):
        for b in slices(batches, 1):
            texts = b.column(1).to_pylist()
            found = [base_spans(t) if t else [] for t in texts]
            for k, (c, run) in enumerate(zip(classes, runs), len(BASE)):
                where, strings = [], []
                for i, t in enumerate(texts):
                    for m in run.finditer(t or ""):
                        if not fine.fullmatch(m[0]):
                            where.append((i, m.start()))
                            strings.append(m[0].encode())
                for s, start, end in entropy_spans(strings, c):
                    i, at = where[s]
                    if not any(x <= at + start and at + end <= y for x, of, y in found[i] if of < len(BASE)):
                        found[i].append((at + start, k, at + end))
            flat = [x for one in found for x in sorted(one)]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            struct = pa.StructArray.from_arrays([pa.array([kinds[x[1]] for x in flat], pa.string()), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), struct)], names=["doc_id", "spans"])

    return map_arrow(docs.select("doc_id", "text"), find, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    patterns = [(ASSIGN, f"length(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= {LEAST_ASSIGNED}"), (ACCESS, f"length(m) >= {LEAST_ACCESS}"), (HEX, "true")]
    patterns += [(f"[{c.characters}]{{{c.window},}}", "NOT (" + " OR ".join(f"regexp_full_match(m, {quoted(p)})" for p in ALLOWED) + ")") for c in CLASSES]
    # a match begins behind all that lies between the matches before it, and these
    parts = [
        f"SELECT r, {k} AS kind, m, start FROM (SELECT r, unnest(ms) AS m, unnest(starts) AS start FROM (SELECT r, regexp_extract_all(t, {quoted(p)}) AS ms, [list_sum([length(x) FOR x IN string_split_regex(t, {quoted(p)})[1:i]]) + coalesce(list_sum([length(x) FOR x IN regexp_extract_all(t, {quoted(p)})[1:i - 1]]), 0) FOR i IN range(1, len(regexp_extract_all(t, {quoted(p)})) + 1)] AS starts FROM d WHERE regexp_matches(t, {quoted(p)}))) WHERE {ok}"
        for k, (p, ok) in enumerate(patterns)
    ]
    widest = max(c.window for c in CLASSES)
    steps = ", ".join(f"({n}, {v})" for n, v in enumerate(step_table(widest).tolist()) if n)
    limits = ", ".join(f"({k}, {c.window}, {c.limit()})" for k, c in enumerate(CLASSES, len(BASE)))
    names = "[" + ", ".join(quoted(k) for k in (*BASE, *[c.kind for c in CLASSES])) + "]"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS MATERIALIZED ({' UNION ALL '.join(parts)}),
step(n, v) AS (VALUES {steps}),
class(kind, size, most) AS (VALUES {limits}),
win AS (SELECT f.r, f.kind, f.start, size, most, f.m, unnest(range(0, length(f.m) - size + 1)) AS o FROM found f JOIN class ON class.kind = f.kind),
chars AS (SELECT r, kind, start, size, most, o, unnest(string_split(substring(m, CAST(o + 1 AS BIGINT), size), '')) AS c FROM win),
hit AS (SELECT r, kind, start, size, start + o AS s FROM (SELECT r, kind, start, size, most, o, c, count(*) AS n FROM chars GROUP BY ALL) x JOIN step ON step.n = x.n GROUP BY r, kind, start, size, most, o HAVING sum(v) <= most),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY r, kind, start ORDER BY s) AS g FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY r, kind, start ORDER BY s) <= size THEN 0 ELSE 1 END AS fresh FROM hit)),
base AS (SELECT r, kind, start AS s, start + length(m) AS e FROM found WHERE kind < {len(BASE)}),
more AS (SELECT r, kind, min(s) AS s, max(s + size) AS e FROM island GROUP BY r, kind, start, g),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.s <= m.s AND m.e <= b.e)),
named AS (SELECT r, kind, s, ({names})[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM spans)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN named ON named.r = d.r GROUP BY d.r, d.doc_id
"""


SQL = _sql()
