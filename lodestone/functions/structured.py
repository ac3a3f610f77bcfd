"""Column expressions of structured values: coordinates, postal addresses, names in parts, stored headers, text by media type, patches, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import collapse

DECIMAL = r"^[+-]?(?=[0-9.]*[0-9])[0-9]*\.?[0-9]*$"
ADDRESS = ("post_office_box", "extended", "street", "locality", "region", "postal_code", "country")
NAME = ("family", "given", "middle", "prefix", "suffix")


def coordinates(c: Column) -> Column:
    """(latitude, longitude) of `geo:53.5,-113.9` or `53.5;-113.9`; null where either is no decimal number."""
    bare = F.regexp_replace(F.trim(c), "^(geo:)?(GEO:)?", "")
    parts = F.when(F.contains(bare, F.lit(",")), F.split(bare, ",", 2)).otherwise(F.split(bare, ";", 2))
    lat, long = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    return F.when(lat.rlike(DECIMAL) & long.rlike(DECIMAL), F.struct(lat.alias("latitude"), long.alias("longitude")))


def address(c: Column) -> Column:
    """A postal address of seven fields or more parted by semicolons, else all of it as the street; empty fields are null."""
    parts = F.split(c, ";", -1)
    field = lambda i: F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit(""))
    whole = F.size(parts) < 7
    return F.struct(*[F.when(~whole, field(i)).otherwise(F.nullif(F.trim(c), F.lit("")) if name == "street" else F.lit(None).cast("string")).alias(name) for i, name in enumerate(ADDRESS)])


def name_parts(c: Column) -> Column:
    """Family, given, middle name, prefix and suffix of a name in parts; commas in a part are blanks, missing parts empty."""
    parts = F.split(c, ";", -1)
    return F.struct(*[F.coalesce(F.trim(F.replace(F.get(parts, F.lit(i)), F.lit(","), F.lit(" "))), F.lit("")).alias(n) for i, n in enumerate(NAME)])


def header_name(c: Column) -> Column:
    """A header's name with each part between dashes capitalised."""
    return F.array_join(F.transform(F.split(F.lower(c), "-", -1), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "-")


def stored_headers(c: Column) -> Column:
    """(name, values) of headers stored as a JSON list of name and value, a JSON map, or raw lines; names in order, capitalised."""
    pairs = F.from_json(c, "array<struct<name:string,value:string>>")
    pairs = F.when(F.ltrim(c).startswith("["), F.filter(pairs, lambda p: F.trim(p["name"]) != ""))
    mapped = F.when(F.ltrim(c).startswith("{"), F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
    lines = F.filter(F.split(F.regexp_replace(c, r"\r?\n[ \t]+", " "), r"\r?\n"), lambda x: x.rlike("^[!-9;-~]+:"))
    raw = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([^:]+):", 1).alias("name"), F.trim(F.regexp_replace(x, "^[^:]+:", "")).alias("value")))
    found = F.transform(F.coalesce(pairs, mapped, raw), lambda p: F.struct(header_name(p["name"]).alias("name"), p["value"].alias("value")))
    names = F.array_sort(F.array_distinct(F.transform(found, lambda p: p["name"])))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.transform(F.filter(found, lambda p: p["name"] == n), lambda p: p["value"]).alias("values")))


def header_text(c: Column) -> Column:
    """Stored headers as lines of name and values."""
    return F.array_join(F.transform(stored_headers(c), lambda h: F.concat(h["name"], F.lit(": "), F.array_join(h["values"], " "))), "\n")


def strip_markup(c: Column) -> Column:
    """HTML without comments, scripts, styles and tags; the common entities resolved."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return bare


def text_of(content: Column, media_type: Column) -> Column:
    """The text of content by its media type, white space collapsed: markup without tags, a mail's body, headers as lines, else all."""
    base = F.lower(F.trim(F.regexp_extract(media_type, "^([^;]*)", 1)))
    blank = F.regexp_instr(content, F.lit(r"\r?\n\r?\n"))
    body = F.when(blank > 0, F.substring(content, blank, F.length(content))).otherwise(content)
    return collapse(F.when(base == "text/html", strip_markup(content)).when(base == "message/rfc822", body).when(base == "text/rfc822-headers", header_text(content)).otherwise(content))


def line_patch(base: Column, target: Column) -> Column:
    """A patch that takes all lines of base away and puts those of target in."""
    signed = lambda c, sign: F.transform(F.filter(F.split(c, "\n", -1), lambda x: x != ""), lambda x: F.concat(F.lit(sign), x, F.lit("\n")))
    return F.concat(F.lit("lodestone-patch-v1\n--- canonical\n+++ variant\n"), F.array_join(signed(base, "-"), ""), F.array_join(signed(target, "+"), ""))


def archive_mailbox(path: Column, kind: str) -> Column:
    """The mailbox of a file in an archive: a maildir's folder, an mbox's path without its ending, else the folder, or the kind at the top."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    if kind == "maildir":
        return F.coalesce(F.nullif(folder(folder(path)), F.lit("")), F.lit("maildir"))
    if kind == "mbox":
        return F.regexp_replace(path, r"\.[^./]*$", "")
    return F.coalesce(F.nullif(folder(path), F.lit("")), F.lit(kind))


def archive_id(path: Column, offset: Column) -> Column:
    return F.when(offset > 0, F.concat(path, F.lit("#"), offset.cast("string"))).otherwise(path)


def without_nul(c: Column) -> Column:
    """JSON text without its escapes of NUL; an escape whose backslash is itself escaped is none."""
    return F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\u0000", "$1")
