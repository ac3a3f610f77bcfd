"""Contact files to facts, and facts to files: vCard, CSV dialects, GEDCOM, BBDB, address book plists, native JSON."""

from __future__ import annotations

import csv
import io
import json
import plistlib
import quopri
import re

Fact = tuple[str, str, str]  # record, kind, value

# Which fact each vCard property, CSV column, GEDCOM tag and address book key stands for.
VCARD = {"FN": "name", "NICKNAME": "alias", "EMAIL": "email", "TEL": "phone", "ORG": "affiliation", "TITLE": "title", "URL": "url", "NOTE": "note", "ADR": "address", "GEO": "coordinates", "TZ": "timezone", "UID": "identifier", "IMPP": "account", "BDAY": "birthday"}
CSV_COLUMNS = {
    "first name": "given", "given name": "given", "last name": "family", "family name": "family", "name": "name", "display name": "name", "full name": "name", "nickname": "alias", "email": "email", "email address": "email",
    "e-mail": "email", "e-mail address": "email", "e-mail 1 - value": "email", "e-mail 2 - value": "email", "email 1": "email", "phone": "phone", "phone number": "phone", "mobile phone": "phone", "phone 1 - value": "phone", "home phone": "phone", "business phone": "phone",
    "current company": "affiliation", "company": "affiliation", "organization": "affiliation", "organization 1 - name": "affiliation", "current position": "title", "position": "title", "job title": "title", "title": "title", "url": "url", "web page": "url", "website 1 - value": "url", "notes": "note", "note": "note", "address": "address",
}
GEDCOM = {"NAME": "name", "EMAIL": "email", "PHON": "phone", "WWW": "url", "OCCU": "title", "NOTE": "note", "ADDR": "address"}
APPLE = {"Email": "email", "Phone": "phone", "URLs": "url", "Address": "address", "Organization": "affiliation", "JobTitle": "title", "Note": "note", "Nickname": "alias"}


def decode(raw: bytes) -> str:
    """Text of a file: UTF-16 by its mark or by its zero bytes, else UTF-8 with broken bytes as ?."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    if len(raw) >= 4 and raw[1:40:2].count(0) > len(raw[1:40:2]) // 2:
        return raw.decode("utf-16-le", "replace")
    return raw.decode("utf-8-sig", "replace").replace("�", "?")


def _unfold(text: str) -> list[str]:
    text = re.sub(r"=\r?\n(?=.)", "=\n", text)
    lines: list[str] = []
    for line in text.splitlines():
        if lines and "ENCODING=QUOTED-PRINTABLE" in lines[-1].upper().split(":")[0] and lines[-1].endswith("="):
            lines[-1] = lines[-1][:-1] + line
        elif line[:1] in (" ", "\t") and lines:
            lines[-1] += line[1:]
        else:
            lines.append(line)
    return lines


def _plain(value: str) -> str:
    return re.sub(r"\\([,;\\nN])", lambda m: "\n" if m[1] in "nN" else m[1], value).strip()


def read_vcards(text: str) -> tuple[list[Fact], list[str]]:
    """Facts of every card, and why others were rejected; a card without a name or any fact is rejected alone."""
    facts, rejected, card, n = [], [], None, 0
    for line in _unfold(text):
        upper = line.strip().upper()
        if upper == "BEGIN:VCARD":
            if card is not None:
                rejected.append(f"card {n}: no end")
            card, n = [], n + 1
        elif upper == "END:VCARD" and card is not None:
            uid = next((v for k, v in card if k == "identifier"), f"card-{n}")
            if any(k == "name" and v for k, v in card):
                facts += [(uid, k, v) for k, v in card if v]
            else:
                rejected.append(f"card {n}: no name")
            card = None
        elif card is not None and ":" in line:
            head, _, value = line.partition(":")
            name, *params = head.split(";")
            name = name.split(".")[-1].upper()
            if any("QUOTED-PRINTABLE" in p.upper() for p in params):
                value = quopri.decodestring(value.encode()).decode("utf-8", "replace")
            if name == "N":
                family, given, *_ = [*(_plain(p) for p in re.split(r"(?<!\\);", value)), "", ""]
                if not any(k == "name" for k, _ in card) and (given or family):
                    card.append(("name", f"{given} {family}".strip()))
            elif name in VCARD:
                kind = VCARD[name]
                if kind == "address":
                    value = ", ".join(p for p in (_plain(x) for x in re.split(r"(?<!\\);", value)) if p)
                elif kind == "affiliation":
                    value = _plain(re.split(r"(?<!\\);", value)[0])
                elif kind == "name":
                    card[:] = [x for x in card if x[0] != "name"]
                value = _plain(value)
                if kind == "email":
                    value = value.removeprefix("mailto:").lower()
                    if not re.fullmatch(r"[^\s@]+@[^\s@]+", value):
                        continue
                card.append((kind, value))
    if card is not None:
        rejected.append(f"card {n}: no end")
    return facts, rejected


def read_csv(text: str) -> list[Fact]:
    """Facts of a contact table with a known header; ValueError where no column is known."""
    text = text.lstrip("﻿")
    first = text.split("\n", 1)[0]
    rows = list(csv.reader(io.StringIO(text), delimiter="\t" if first.count("\t") > first.count(",") else ","))
    start = next((i for i, r in enumerate(rows) if any(c.strip().lower() in CSV_COLUMNS for c in r)), None)
    if start is None:
        raise ValueError("no known column in the header")
    kinds = [CSV_COLUMNS.get(re.sub(r"\s+", " ", c.strip().lower())) for c in rows[start]]
    facts = []
    for i, row in enumerate(rows[start + 1 :]):
        record, given, family, named = f"row-{i}", "", "", False
        for kind, value in zip(kinds, row):
            value = value.strip()
            if not kind or not value:
                continue
            if kind == "given":
                given = value
            elif kind == "family":
                family = value
            else:
                named |= kind == "name"
                facts.append((record, kind, value.lower() if kind == "email" else value))
        if (given or family) and not named:
            facts.append((record, "name", f"{given} {family}".strip()))
    return facts


def read_gedcom(text: str) -> list[Fact]:
    """Facts of individuals, and child_of, parent_of and spouse_of edges of families."""
    facts, record, kind, families = [], None, "", {}
    for line in text.splitlines():
        m = re.match(r"\s*(\d+)\s+(?:@([^@]+)@\s+)?(\w+)\s?(.*)$", line)
        if not m:
            continue
        level, ref, tag, value = int(m[1]), m[2], m[3].upper(), m[4].strip()
        if level == 0:
            record, kind = ref, tag
        elif level == 1 and record and kind == "INDI" and tag in GEDCOM and value:
            facts.append((record, GEDCOM[tag], value.replace("/", "").strip()))
        elif level == 1 and record and kind == "FAM" and tag in ("HUSB", "WIFE", "CHIL"):
            families.setdefault(record, []).append((tag, value.strip("@")))
    for members in families.values():
        parents = [r for t, r in members if t != "CHIL"]
        for child in (r for t, r in members if t == "CHIL"):
            for p in parents:
                facts += [(child, "child_of", p), (p, "parent_of", child)]
        if len(parents) == 2:
            facts += [(parents[0], "spouse_of", parents[1]), (parents[1], "spouse_of", parents[0])]
    return facts


def _sexp(text: str):
    stack: list[list] = [[]]
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"|([\[(])|([\])])|([^\s\[\]()"]+)', text):
        if m[2]:
            stack.append([])
        elif m[3]:
            done = stack.pop()
            stack[-1].append(done)
        elif m[4]:
            stack[-1].append(None if m[4] == "nil" else m[4])
        else:
            stack[-1].append(re.sub(r"\\(.)", r"\1", m[1]))
    return stack[0]


def read_bbdb(text: str) -> list[Fact]:
    """Facts of BBDB vectors: first, last, affixes, aka, organisations, phones, addresses, mail, fields."""
    body = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith(";"))
    facts = []
    for i, v in enumerate(x for x in _sexp(body) if isinstance(x, list)):
        record = f"bbdb-{i}"
        v = [*v, *[None] * 9]
        name = " ".join(p for p in (v[0], v[1]) if isinstance(p, str))
        if name:
            facts.append((record, "name", name))
        facts += [(record, "alias", a) for a in (v[3] or []) if isinstance(a, str)]
        facts += [(record, "affiliation", o) for o in (v[4] if isinstance(v[4], list) else [v[4]] if v[4] else [])]
        for p in v[5] or []:
            digits = [x for x in p[1:] if isinstance(x, str)]
            if digits:
                facts.append((record, "phone", "-".join(digits)))
        facts += [(record, "email", m.lower()) for m in (v[7] or []) if isinstance(m, str)]
    return facts


def read_address_book(raw: bytes) -> list[Fact]:
    """Facts of an address book person, from an XML or binary plist with typed multi-values."""
    data = plistlib.loads(raw)
    record = data.get("UID") or "person"
    name = " ".join(x for x in (data.get("First"), data.get("Last")) if x) or data.get("Name", "")
    facts = [(record, "name", name)] if name else []
    for key, kind in APPLE.items():
        value = data.get(key)
        if isinstance(value, dict):
            for x in value.get("values", []):
                if isinstance(x, dict):
                    x = ", ".join(str(x[k]) for k in ("Street", "City", "State", "ZIP", "Country") if x.get(k))
                if x:
                    facts.append((record, kind, str(x).lower() if kind == "email" else str(x)))
        elif value:
            facts.append((record, kind, str(value)))
    for member in data.get("ABMembers", []):
        facts.append((record, "member", member))
    return facts


def read_native(text: str) -> list[Fact]:
    """Facts of an export of write_native."""
    data = json.loads(text)
    return [(c["contact_id"], f["kind"], f["value"]) for c in data.get("contacts", []) for f in c.get("facts", [])]


READERS = {"vcard": lambda raw: read_vcards(decode(raw))[0], "csv": lambda raw: read_csv(decode(raw)), "gedcom": lambda raw: read_gedcom(decode(raw)), "bbdb": lambda raw: read_bbdb(decode(raw)), "apple": read_address_book, "json": lambda raw: read_native(decode(raw))}


def _escape(value: str) -> str:
    return re.sub(r"([\\,;])", r"\\\1", value).replace("\n", "\\n")


def write_vcard(contact_id: str, facts: list[tuple[str, str, bool]]) -> str:
    """One card of (kind, value, historical) facts in order; historical emails are left out, other names are nicknames."""
    names = [v for k, v, _ in facts if k == "name"]
    lines = ["BEGIN:VCARD", "VERSION:4.0", f"UID:{_escape(contact_id)}", f"FN:{_escape(names[0] if names else contact_id)}"]
    props = {k: p for p, k in VCARD.items() if k not in ("name", "identifier")}
    for kind, value, historical in sorted(facts):
        if kind == "name" and names and value != names[0]:
            lines.append(f"NICKNAME:{_escape(value)}")
        elif kind in props and not (kind == "email" and historical):
            lines.append(f"{props[kind]}:{_escape(value)}")
    return "\r\n".join([*lines, "END:VCARD", ""])


def write_turtle(contact_id: str, facts: list[tuple[str, str, bool]], prefix: str = "http://xmlns.com/foaf/0.1/") -> str:
    terms = {"name": "name", "alias": "nick", "email": "mbox", "phone": "phone", "url": "homepage", "title": "title"}
    quoted = lambda v: json.dumps(v, ensure_ascii=False)
    lines = [f"<{contact_id}> <{prefix}{terms[k]}> {quoted(v)} ." for k, v, _ in sorted(facts) if k in terms]
    return "\n".join([f"<{contact_id}> a <{prefix}Person> .", *lines]) + "\n"


def write_native(contacts: dict[str, list[tuple[str, str, bool]]]) -> str:
    return json.dumps({"schema_version": 1, "contacts": [{"contact_id": c, "facts": [{"kind": k, "value": v, "historical": h} for k, v, h in sorted(f)]} for c, f in sorted(contacts.items())]}, ensure_ascii=False)
