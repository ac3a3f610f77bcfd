"""A line-oriented reader of Turtle with quoted triples."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"""<<|>>|<[^<>\s]*>|\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\]|\\.)*"|@[A-Za-z][\w-]*|\^\^|\[|\]|\{\||\|\}|[;,.](?=\s|$)|[^\s;,<>"\[\]]+(?<![.,;])|[;,.]""",
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "'": "'"}
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@dataclass(frozen=True)
class Term:
    kind: str
    value: str
    lang: str = ""
    datatype: str = ""

    @property
    def key(self) -> str:
        return hashlib.sha256("\0".join((self.kind, self.value, self.lang, self.datatype)).encode()).hexdigest()


@dataclass(frozen=True)
class Statement:
    subject: Term
    predicate: str
    object: Term
    order: int

    @property
    def hash(self) -> str:
        return hashlib.sha256("\0".join((self.subject.key, self.predicate, self.object.key)).encode()).hexdigest()


def _unescape(s: str) -> str:
    s = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), s)
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), s)


def _without_comments(text: str) -> str:
    out = []
    for line in text.splitlines():
        keep, quoted, angle, i = len(line), False, False, 0
        while i < len(line):
            c = line[i]
            if quoted and c == "\\":
                i += 1
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "<>":
                angle = c == "<"
            elif c == "#" and not quoted and not angle:
                keep = i
                break
            i += 1
        out.append(line[:keep])
    return "\n".join(out)


def parse(text: str) -> tuple[list[Statement], list[tuple[Statement, str, Term]]]:
    """Statements, and annotations of quoted triples; statements about blank [ ] nodes are left out."""
    tokens = TOKEN.findall(_without_comments(text))
    prefixes: dict[str, str] = {}
    found: list[Statement] = []
    notes: list[tuple[Statement, str, Term]] = []
    pos = 0

    def iri(token: str) -> str:
        if token.startswith("<"):
            return token[1:-1]
        if token == "a":
            return RDF_TYPE
        head, _, tail = token.partition(":")
        return prefixes.get(head, head + ":") + tail

    def term() -> Term | None:
        nonlocal pos
        t = tokens[pos]
        pos += 1
        if t.startswith('"'):
            value = _unescape(t[3:-3] if t.startswith('"""') else t[1:-1])
            if pos < len(tokens) and tokens[pos].startswith("@"):
                pos += 1
                return Term("literal", value, lang=tokens[pos - 1][1:].lower())
            if pos < len(tokens) and tokens[pos] == "^^":
                pos += 2
                return Term("literal", value, datatype=iri(tokens[pos - 1]))
            return Term("literal", value)
        if t == "[":
            depth = 1
            while pos < len(tokens) and depth:
                depth += {"[": 1, "]": -1}.get(tokens[pos], 0)
                pos += 1
            return None
        if re.fullmatch(r"[+-]?\d+(\.\d+)?|true|false", t):
            return Term("literal", t)
        return Term("blank" if t.startswith("_:") else "iri", t if t.startswith("_:") else iri(t))

    while pos < len(tokens):
        t = tokens[pos]
        if t in ("@prefix", "PREFIX"):
            prefixes[tokens[pos + 1].rstrip(":")] = tokens[pos + 2][1:-1]
            pos += 4 if pos + 3 < len(tokens) and tokens[pos + 3] == "." else 3
            continue
        if t in ("@base", "BASE", "."):
            pos += 1 if t == "." else 2
            continue
        quoted = None
        if t == "<<":
            pos += 1
            s = term()
            p = iri(tokens[pos])
            pos += 1
            o = term()
            pos += 1  # >>
            quoted, subject = Statement(s, p, o, -1), s
        else:
            subject = term()
        while pos < len(tokens) and tokens[pos] != ".":
            predicate = iri(tokens[pos])
            pos += 1
            while pos < len(tokens):
                value = term()
                if subject is not None and value is not None:
                    if quoted is not None:
                        notes.append((quoted, predicate, value))
                    else:
                        found.append(Statement(subject, predicate, value, len(found)))
                if pos < len(tokens) and tokens[pos] == ",":
                    pos += 1
                    continue
                break
            while pos < len(tokens) and tokens[pos] == ";":
                pos += 1
        pos += 1
    return found, notes
