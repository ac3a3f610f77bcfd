"""Mail parsing: mbox files, messages with their parts, address lists, participants, HTML to text, embedding segments."""

from __future__ import annotations

import email
import email.policy
import hashlib
import html
import re
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser

BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "form", "title"}
SKIPPED = {"script", "style", "template", "noscript"}
PARTICIPANT_HEADERS = ("from", "sender", "reply_to", "to", "cc", "bcc")
SEGMENT, LETTERS = 1200, 16


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden += 1
        elif tag in BLOCKS:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out += [data, " "]


def html_to_text(source: str | None) -> str:
    """Visible text: scripts and styles left out, block tags as blanks, entities resolved, white space collapsed."""
    parser = _Text()
    parser.feed(source or "")
    parser.close()
    return " ".join("".join(parser.out).split())


def split_mbox(raw: bytes) -> list[tuple[int, bytes]]:
    """(ordinal, message) of an mbox: parted at lines that begin with "From ", one > taken from ">From " lines."""
    found, lines = [], []
    started = False

    def close():
        body = b"".join(lines)
        found.append((len(found), body.rstrip(b"\r\n") + b"\n" if body.strip() else b""))

    for line in raw.splitlines(keepends=True):
        if line.startswith(b"From "):
            if started:
                close()
            started, lines = True, []
        elif started:
            lines.append(line[1:] if re.match(rb">+From ", line) else line)
    if started:
        close()
    return found


def split_addresses(value: str | None) -> list[str]:
    """An address list parted at commas and semicolons outside quotes, comments and angle brackets."""
    out, now, quoted, depth, angle, skip = [], [], False, 0, False, False
    for c in value or "":
        if skip:
            now.append(c)
            skip = False
            continue
        if c == "\\":
            skip = True
        elif c == '"' and not depth:
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth = max(0, depth - 1)
        elif not quoted and not depth and c in "<>":
            angle = c == "<"
        elif c in ",;" and not (quoted or depth or angle):
            out.append("".join(now))
            now = []
            continue
        now.append(c)
    out.append("".join(now))
    return [x.strip() for x in out if x.strip()]


def parse_address(value: str) -> tuple[str, str] | None:
    """(name, lower-cased address) of one entry, or None when it has no address."""
    m = re.search(r"<\s*([^<>\s]+@[^<>\s]+)\s*>", value)
    if m:
        name = (value[: m.start()] + value[m.end() :]).strip()
        address = m[1]
    else:
        bare = re.sub(r"\([^()]*\)", " ", value).strip()
        if not re.fullmatch(r"[^\s@<>]+@[^\s@<>]+", bare):
            return None
        comment = re.search(r"\(([^()]*)\)", value)
        name, address = (comment[1] if comment else ""), bare
    name = re.sub(r"\\(.)", r"\1", name.strip().strip('"').strip())
    return name, address.lower().rstrip(".,;")


def participants(headers: dict[str, str]) -> list[tuple[str, int, str, str, str, str]]:
    """(role, ordinal, token, token_hash, display, raw) of the six address headers; entries without an address are left out."""
    out = []
    for role in PARTICIPANT_HEADERS:
        n = 0
        for raw in split_addresses(headers.get(role) or headers.get(role.replace("_", "-"))):
            found = parse_address(raw)
            if found:
                name, token = found
                out.append((role, n, token, hashlib.sha256(token.encode()).hexdigest(), name, raw))
                n += 1
    return out


def normal_id(value: str | None) -> str:
    bare = (value or "").strip().strip("<>").strip().lower()
    return f"<{bare}>" if bare else ""


def message_time(value: str | None) -> str:
    """An RFC 5322 or ISO date as UTC, or empty."""
    from datetime import UTC, datetime

    for parse in (parsedate_to_datetime, lambda v: datetime.fromisoformat(v.replace("Z", "+00:00"))):
        try:
            t = parse((value or "").strip())
            t = t if t.tzinfo else t.replace(tzinfo=UTC)
            return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        except (ValueError, TypeError, IndexError, OverflowError):
            continue
    return ""


def parse_message(raw: bytes) -> dict:
    """Headers, body and attachments. Plain text beats HTML; a part is an attachment if its disposition says so or it has a file name."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    plain, rich, files = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        body = part.get_payload(decode=True) or b""
        if part.get_content_disposition() == "attachment" or name:
            files.append({"name": name or "", "media_type": part.get_content_type(), "size": len(body), "sha256": hashlib.sha256(body).hexdigest()})
        elif part.get_content_type() in ("text/plain", "text/html"):
            try:
                text = body.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
            (plain if part.get_content_type() == "text/plain" else rich).append(text)
    header = lambda k: str(email.header.make_header(email.header.decode_header(m[k]))) if m[k] else ""
    body = "\n".join(plain) if any(p.strip() for p in plain) else html_to_text("\n".join(rich))
    mid = normal_id(m["Message-ID"])
    generated = not mid
    if generated:
        mid = f"<generated-{hashlib.sha256(raw).hexdigest()[:32]}@local>"
    return {"message_id": mid, "generated": generated, "subject": header("Subject"), "from": header("From"), "to": header("To"), "cc": header("Cc"), "date": message_time(m["Date"]), "body": body.strip(), "attachments": files}


def segments(texts: list[str], target: int = SEGMENT) -> list[tuple[int, str]]:
    """(ordinal, segment): up to `target` characters, cut after the last sentence end of the back half, else at its last blank, else hard.

    Ordinals count every cut; segments of fewer than LETTERS letters are left out.
    """
    rest, out, n = "\n".join(t for t in texts if t).strip(), [], 0
    while rest:
        cut = len(rest)
        if cut > target:
            half = target // 2
            marks = [i for i in range(half, target) if rest[i] in ".!?\n"]
            blank = rest.rfind(" ", half, target)
            cut = marks[-1] + 1 if marks else blank if blank > 0 else target
        piece, rest = rest[:cut].strip(), rest[cut:].strip()
        if sum(c.isalpha() for c in piece) >= LETTERS:
            out.append((n, piece))
        n += 1
    return out


def unescape(value: str) -> str:
    return html.unescape(value)
