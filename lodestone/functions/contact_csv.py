"""Contact tables of address books: which program wrote one, what its columns mean, and which rows and columns are rejected."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Mapping

from lodestone.functions.contact_formats import CSV_COLUMNS

# Dialects in the order in which they are tried, each with the column sets that tell it, and columns that mean something else in one.
SIGNATURES = (
    ("linkedin-connections", ({"first name", "last name", "email address", "current company"}, {"first name", "last name", "email address", "current position"}, {"first name", "last name", "email address", "connected on"})),
    ("linkedin-section", ({"company name", "start date", "end date", "title"}, {"school name", "start date", "end date"}, {"skill name"}, {"course name"}, {"name", "proficiency"}, {"email address", "status", "is primary"}, {"first name", "last name", "headline", "summary"})),
    ("google-contacts", ({"name", "given name", "family name"},)),
    ("outlook-contacts", ({"e-mail address", "business street"}, {"e-mail address", "home street"})),
    ("yahoo-contacts", ({"first", "last", "email"},)),
    ("simple-name-email", ({"first name", "last name", "email"},)),
)
COLUMNS = {
    "linkedin-connections": {"connected on": "note"},
    "linkedin-section": {"skill name": "expertise", "course name": "expertise", "school name": "affiliation", "company name": "affiliation", "headline": "title", "summary": "note", "start date": "since", "end date": "until", "name": "expertise", "proficiency": "note", "status": "note", "is primary": "note"},
    "google-contacts": {"birthday": "birthday"},
    "outlook-contacts": {"business street": "address", "home street": "address", "mobile phone": "phone"},
    "yahoo-contacts": {"first": "given", "last": "family", "mobile": "phone"},
    "simple-name-email": {},
}
#: Columns that show who a row is about.
IDENTIFYING = {"name", "given", "family", "alias", "email", "phone", "url"}


def plain(column: str) -> str:
    return re.sub(r"\s+", " ", column.strip().lower().lstrip("﻿"))


def dialect_of(header: list[str]) -> str | None:
    """The first dialect one of whose column sets the header holds."""
    held = {plain(c) for c in header}
    return next((name for name, sets in SIGNATURES if any(s <= held for s in sets)), None)


def read_dialect(text: str, columns: Mapping[str, str] | None = None) -> list[tuple[str, str, str]]:
    """(record, kind, value) of a contact table: first its dialect, then facts of its rows by number, and what is rejected.

    columns (name to kind, or to an empty kind: left out on purpose) go before the dialect's, which go before the common ones. With them
    a table of no known dialect is read too. Columns without a meaning are `unmapped`, rows that name nobody `rejected`. The header
    is the first line that tells a dialect or holds one of the given columns; lines before it are notes. A given and a family name
    without a full one make it. ValueError where there is no header.
    """
    given = {plain(k): v for k, v in (columns or {}).items()}
    first = text.split("\n", 1)[0]
    rows = list(csv.reader(io.StringIO(text), delimiter=max(",;\t", key=first.count)))
    start = next((i for i, r in enumerate(rows) if dialect_of(r) or given.keys() & {plain(c) for c in r}), None)
    if start is None:
        raise ValueError("the header tells no known dialect")
    dialect = dialect_of(rows[start]) or "custom"
    meaning = CSV_COLUMNS | COLUMNS.get(dialect, {}) | given
    kinds = [meaning.get(plain(c)) for c in rows[start]]
    out = [("", "dialect", dialect)] + [("", "unmapped", c.strip()) for c, k in zip(rows[start], kinds) if k is None and c.strip()]
    for i, row in enumerate(rows[start + 1 :]):
        facts = [(k, v.strip()) for k, v in zip(kinds, row) if k and v.strip()]
        if not any(v.strip() for v in row):
            continue
        if not IDENTIFYING & {k for k, _ in facts} and dialect != "linkedin-section":
            out.append((f"row-{i}", "rejected", "no contact identity"))
            continue
        names = [v for want in ("given", "family") for k, v in facts if k == want]
        if names and not any(k == "name" for k, _ in facts):
            out.append((f"row-{i}", "name", " ".join(names)))
        out += [(f"row-{i}", k, v.lower() if k == "email" else v) for k, v in facts if k not in ("given", "family")]
    return out
