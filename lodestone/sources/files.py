"""File sources: folders of any files, mail archives and contact files, read by Spark's own binary reader."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import contact_csv, contact_formats, mail, rdf

MEDIA = {"eml": "message/rfc822", "mbox": "application/mbox", "html": "text/html", "htm": "text/html", "txt": "text/plain", "md": "text/markdown", "json": "application/json", "ttl": "text/turtle", "vcf": "text/vcard", "csv": "text/csv", "ged": "text/vnd.familysearch.gedcom", "pdf": "application/pdf"}
SKIPPED = r"/(tmp|\.git)/|/(\.overview|\.marks|active|\.mh_sequences)$"


def files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, media_type, modified, length, content of all files below a folder, in path order where a limit is given."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substr(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), F.lit(len(re.sub("^[a-z0-9]+:/+", "/", path.rstrip("/"))) + 1))
    df = df.where(~below.rlike(SKIPPED))
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])[extension], F.when(F.substring(F.col("content").cast("string"), 1, 5).isin("From ", "Retur"), "message/rfc822"), F.lit("application/octet-stream"))
    out = df.select("path", kind.alias("media_type"), F.col("modificationTime").alias("modified"), "length", "content")
    return out.orderBy("path").limit(limit) if limit else out


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """Rows of function(path, content), a file at a time."""
    fields = [f.split()[0] for f in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(function(path, content or b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

    return df.select("path", "content").mapInArrow(run, schema)


def archive_messages(df: DataFrame) -> DataFrame:
    """external_id, mailbox, message of mbox files (one row a message, id path#n) and single-message files."""

    def split(path, content):
        box = path.rstrip("/").split("/")[-2] if "/" in path else ""
        if content[:5] == b"From ":
            name = path.split("/")[-1].removesuffix(".mbox")
            for n, raw in mail.split_mbox(content):
                yield f"{path}#{n}", name, raw
        elif content.strip():
            yield path, box if box not in ("cur", "new") else path.split("/")[-3], content

    return _mapped(df, split, "external_id string, mailbox string, message binary")


def messages(df: DataFrame) -> DataFrame:
    """Parsed messages of a table with path (or external_id) and content (or message)."""

    def parse(path, raw):
        try:
            m = mail.parse_message(raw)
        except Exception as e:  # a finding, not a failure: one broken message must not stop an import
            yield path, "", True, "", "", "", "", "", 0, f"{type(e).__name__}"
            return
        yield path, m["message_id"], m["generated"], m["subject"], m["from"], m["to"], m["date"], m["body"], len(m["attachments"]), ""

    source = df.select(F.col(df.columns[0]).alias("path"), F.col("message" if "message" in df.columns else "content").alias("content"))
    return _mapped(source, parse, "external_id string, message_id string, generated boolean, subject string, sender string, recipients string, date string, body string, attachments int, finding string")


def contact_facts(df: DataFrame, fmt: str) -> DataFrame:
    """path, record, kind, value of contact files in a format of contact_formats.READERS."""
    reader = contact_formats.READERS[fmt]

    def read(path, content):
        try:
            yield from ((path, *f) for f in reader(content))
        except (ValueError, KeyError) as e:
            yield path, "", "finding", str(e)

    return _mapped(df, read, "path string, record string, kind string, value string")


def dialect_facts(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """path, record, kind, value of contact tables in any dialect of contact_csv, with what each file's rows and columns were rejected for."""

    def read(path, content):
        try:
            yield from ((path, *f) for f in contact_csv.read_dialect(contact_formats.decode(content), columns))
        except ValueError as e:
            yield path, "", "finding", str(e)

    return _mapped(df, read, "path string, record string, kind string, value string")


def rdf_rows(df: DataFrame) -> DataFrame:
    """path, ord, subject, predicate, object, object_kind, lang, statement_hash, note (annotation's predicate and value, or empty)."""

    def read(path, content):
        found, notes = rdf.parse(contact_formats.decode(content))
        for s in found:
            yield path, s.order, s.subject.value, s.predicate, s.object.value, s.object.kind, s.object.lang, s.hash, ""
        for q, p, o in notes:
            yield path, -1, q.subject.value, q.predicate, q.object.value, q.object.kind, q.object.lang, q.hash, json.dumps([p, o.value])

    return _mapped(df, read, "path string, ord int, subject string, predicate string, object string, object_kind string, lang string, statement_hash string, note string")
