"""Scalar text functions as column expressions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_col = lambda c: F.col(c) if isinstance(c, str) else c

# Titles and generation marks that don't count as words of a name; fewest digits of a phone number.
HONORIFICS = ["mr", "mrs", "ms", "mx", "dr", "prof", "rev", "hon", "sir", "dame", "lord", "lady", "sri", "smt", "sayyid", "san", "sama"]
GENERATIONS = ["jr", "jnr", "sr", "snr", "i", "ii", "iii", "iv", "v"]
PHONE_DIGITS = 7


def tokens(c) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def collapse(c) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"[ \t\n\r\x0b\x0c]+", " "))


def sha256_hex(c) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def joined_hash(*parts) -> Column:
    """SHA-256 of the parts with NUL between them."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def message_id(c) -> Column:
    """A message id in lower case and angle brackets; empty stays empty."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(_col(c)), r"^<+|>+$", "")))
    return F.when(bare == "", "").otherwise(F.concat(F.lit("<"), bare, F.lit(">")))


def message_fingerprint(message, subject, sender, to, body) -> Column:
    """The first 32 hex digits of a hash over id and the collapsed headers and body."""
    parts = [message_id(message), *[collapse(F.coalesce(_col(c), F.lit(""))) for c in (subject, sender, to, body)]]
    return F.substring(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), 1, 32)


def body_fingerprint(c) -> Column:
    """A hash of the body's lines, each collapsed, blank ones left out."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "\r\n?", "\n"), "\n"), collapse)
    return F.sha2(F.array_join(F.filter(lines, lambda x: x != ""), "\n").cast("binary"), 256)


def phone(c) -> Column:
    """Digits only, a North American 1 before ten digits dropped; empty under seven digits."""
    digits = F.regexp_replace(_col(c), "[^0-9]", "")
    digits = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(digits) >= PHONE_DIGITS, digits).otherwise("")


def url(c) -> Column:
    """Lower-cased without scheme, leading www. and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), r"^[a-z]+://(www\.)?|^www\.", ""), "/+$", "")


def email(c) -> Column:
    """The address of a bare address, a mailto: IRI or "Name <address>", trimmed and lower-cased."""
    bare = F.regexp_replace(F.trim(_col(c)), "^(mailto:|MAILTO:)", "")
    inner = F.regexp_extract(bare, "^.*<([^>]*)>", 1)
    return F.lower(F.trim(F.when(bare.rlike("<[^<>]*>"), inner).otherwise(bare)))


def alias_slug(c) -> Column:
    """Letters and digits of a-z in lower case; runs of - _ . and blanks as one dash, none at the ends."""
    kept = F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9\-_. ]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\-_. ]+", "-"), "^-|-$", "")


def name_tokens(c) -> Column:
    """The words of a person's name, without titles and generation marks."""
    words = F.split(F.regexp_replace(F.lower(_col(c)), r"[.,]", " "), r"[ \t\n\r\x0b\x0c]+")
    return F.filter(words, lambda x: (x != "") & ~x.isin(HONORIFICS + GENERATIONS))


def usable(c, letters: int = 16) -> Column:
    return F.length(F.regexp_replace(_col(c), r"[^\p{L}]", "")) >= letters


def stable_uid(c) -> Column:
    """A 31-bit rolling hash (times 33) of the characters' code points; 0 becomes 1."""
    codes = F.transform(F.split(_col(c), ""), lambda x: F.ascii(x).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: F.pmod(a * 33 + x, F.lit(1 << 31)))
    return F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h)


def snippet(text, needle: str, before: int = 80, after: int = 120) -> Column:
    """The surroundings of the first hit in collapsed text, escaped, the hit in <mark>; null without a hit."""
    flat = collapse(text)
    at = F.locate(needle.lower(), F.lower(flat))
    start = F.greatest(F.lit(1), at - before)
    end = F.least(F.length(flat) + 1, at + len(needle) + after)
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&#34;")), F.lit("'"), F.lit("&#39;"))
    cut = lambda s, n: escape(F.substr(flat, s, n))
    return F.when(at > 0, F.trim(F.concat(
        F.when(start > 1, F.lit("...")).otherwise(F.lit("")), cut(start, at - start), F.lit("<mark>"), cut(at, F.lit(len(needle))), F.lit("</mark>"),
        cut(at + len(needle), F.greatest(F.lit(0), end - at - len(needle))), F.when(end <= F.length(flat), F.lit("...")).otherwise(F.lit("")),
    )))
