"""Links and actors in notifications, account addresses, summary checks, graph query guard."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a graph query as one that only reads, and what it must not hold.
READS = re.compile(r"^\s*(MATCH|WITH|UNWIND|RETURN)\b", re.I)
WRITES = re.compile(r"\b(CREATE|MERGE|DELETE|DETACH|SET|REMOVE|DROP|CALL|LOAD|FOREACH)\b", re.I)
COLUMN = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*( [A-Za-z_][A-Za-z0-9_]*)?$")
SUMMARY_CHARS, SUMMARY_BULLETS, ECHO_CHARS = 500, 3, 80


def first_url(c: Column) -> Column:
    return F.regexp_extract(c, r"https?://[^\s<>\"')\]]+", 0)


def review_link(c: Column) -> Column:
    """The first link to a pull or merge request."""
    return F.regexp_extract(c, r"https?://[^\s<>\"')\]]+/(?:pull|pulls|merge_requests)/\d+", 0)


def actor(c: Column) -> Column:
    """Who did something, of "name commented / approved / requested ..."."""
    return F.regexp_extract(c, r"(?m)^\s*@?([\w.-]+) (?:commented|approved|requested|pushed|merged|closed|opened)\b", 1)


def account_of(c: Column, suffix: str) -> Column:
    """The instant-messaging account behind an address that ends with `suffix` (`name.service` + suffix); empty for other addresses. \\40-style escapes are undone."""
    bare = F.lower(F.trim(c))
    inner = F.substr(bare, F.lit(1), F.greatest(F.lit(0), F.length(bare) - len(suffix)))
    plain = F.replace(F.replace(F.replace(inner, F.lit("\\40"), F.lit("@")), F.lit("\\20"), F.lit(" ")), F.lit("\\5c"), F.lit("\\"))
    return F.when(bare.endswith(suffix), plain).otherwise("")


def valid_summary(summary: str, source: str) -> tuple[bool, str]:
    """Whether a model's summary may be stored: short, few bullets, and no long stretch copied from its source."""
    text = summary.strip()
    if not text:
        return False, "empty"
    if len(text) > SUMMARY_CHARS:
        return False, "too long"
    if sum(bool(re.match(r"\s*([-*•]|\d+[.)])\s", x)) for x in text.splitlines()) > SUMMARY_BULLETS:
        return False, "too many bullets"
    flat, hay = " ".join(text.split()).lower(), " ".join(source.split()).lower()
    if any(flat[i : i + ECHO_CHARS + 1] in hay for i in range(len(flat) - ECHO_CHARS)):
        return False, "echoes its source"
    return True, ""


def guard_graph_query(query: str, columns: list[str], limit: int = 100) -> str:
    """The query with a LIMIT; ValueError unless it only reads and its columns are plain names."""
    body = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", query)
    if not READS.search(body) or WRITES.search(body) or ";" in body or "RETURN" not in body.upper():
        raise ValueError("the query must only read")
    if not columns or any(not COLUMN.match(c) for c in columns):
        raise ValueError("columns must be plain names with an optional type")
    return query if re.search(r"\bLIMIT\b", body, re.I) else f"{query.rstrip()} LIMIT {limit}"
