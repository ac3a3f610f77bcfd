"""Registered queries of parsers and exports: inputs are made from the tables, parsed by the same code as files. No SQL; tests hold them against literals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import contact_formats, mail
from lodestone.operators.common import map_texts
from lodestone.plans.views import Views
from lodestone.sources import files as f


def _html(s, d):
    def run(batches):
        for b in batches:
            out = [mail.html_to_text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["page_id", "text"])

    return map_texts(Views(s, d).table("pages").select("page_id", "html"), run, "page_id bigint, text string")


def _segments(s, d):
    def run(batches):
        for b in batches:
            rows = [(i, n, t) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, t in mail.segments([x or ""])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "ordinal", "segment"])

    return map_texts(Views(s, d).table("documents").select("doc_id", "text"), run, "doc_id bigint, ordinal int, segment string")


def _mbox_files(s, d):
    c = Views(s, d).table("conversations")
    one = F.concat(F.lit("From x@y.example Mon Jan  1 00:00:00 2024\nMessage-ID: <"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("@mail.example>\nFrom: "), F.col("role"), F.lit(" <"), F.col("role"), F.lit("@mail.example>\nTo: All <all@mail.example>, second@mail.example\nSubject: Turn "), F.col("turn").cast("string"), F.lit("\nDate: Mon, 01 Jan 2024 10:00:00 +0200\n\n"), F.regexp_replace("text", "(?m)^From ", ">From "), F.lit("\n\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("m")))), lambda x: x["m"]), "")
    return c.groupBy("conv_id").agg(body.cast("binary").alias("content")).select(F.concat(F.lit("mail/box-"), F.col("conv_id").cast("string"), F.lit(".mbox")).alias("path"), "content")


def _people(s, d):
    return Views(s, d).spread("customer", "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


def _vcards(s, d):
    p = _people(s, d)
    card = F.concat(F.lit("BEGIN:VCARD\r\nVERSION:3.0\r\nUID:c"), F.col("c_custkey").cast("string"), F.lit("\r\nFN:"), F.col("c_name"), F.lit("\r\nORG:"), F.col("c_mktsegment"), F.lit(";Unit\r\nEMAIL;TYPE=work:Person"), F.col("c_custkey").cast("string"), F.lit("@Mail.Example\r\nNOTE:a folded\r\n  line\\, with a comma\r\nEND:VCARD\r\n"))
    return f.contact_facts(p.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".vcf")).alias("path"), card.cast("binary").alias("content")), "vcard")


def _csvs(s, d):
    p = _people(s, d).groupBy("c_mktsegment", F.expr("c_custkey div 200").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.concat(F.lit("Person,"), x["c_name"], F.lit(",p"), x["c_custkey"].cast("string"), F.lit("@mail.example,Works"))), "\n").alias("body"))
    text = F.concat(F.lit("﻿First Name,Last Name,Email Address,Current Company\n"), "body")
    return f.contact_facts(p.select(F.concat_ws("-", "c_mktsegment", F.concat(F.col("part").cast("string"), F.lit(".csv"))).alias("path"), text.cast("binary").alias("content")), "csv")


#: Header and row of a table of each dialect; {0} is the family name, {1} the address.
_TABLES = (
    ("linkedin-connections", "First Name,Last Name,Email Address,Connected On", "Person,{0},{1},2020"), ("google-contacts", "Name,Given Name,Family Name,E-mail 1 - Value,Shoe", "Person {0},Person,{0},{1},"),
    ("outlook-contacts", "First Name;Last Name;E-mail Address;Home Street", "Person;{0};{1};Road"), ("yahoo-contacts", "First\tLast\tEmail", "Person\t{0}\t{1}"), ("simple-name-email", "First Name,Last Name,Email", "Person,{0},{1}"), ("linkedin-section", "Skill Name", "{0}"),
)


def _dialects(s, d):
    dialect = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in _TABLES]), (F.col("c_custkey") % len(_TABLES) + 1).cast("int"))
    row = F.replace(F.replace(dialect(2), F.lit("{0}"), F.col("c_name")), F.lit("{1}"), F.concat(F.lit("P"), F.col("c_custkey").cast("string"), F.lit("@Mail.example")))
    p = _people(s, d).select(F.concat_ws("-", dialect(0), F.expr("c_custkey div 600").cast("string")).alias("path"), dialect(1).alias("header"), "c_custkey", row.alias("row"))
    p = p.groupBy("path").agg(F.first("header").alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))), lambda x: x["row"]), "\n").alias("body"))
    return f.dialect_facts(p.select("path", F.concat_ws("\n", "header", "body").cast("binary").alias("content")))


def _rdf(s, d):
    p = _people(s, d)
    text = F.concat(F.lit("@prefix foaf: <http://xmlns.com/foaf/0.1/> .\n<urn:c"), F.col("c_custkey").cast("string"), F.lit("> a foaf:Person ; foaf:name \""), F.col("c_name"), F.lit("\"@en , \"Other\" ; foaf:mbox <mailto:p"), F.col("c_custkey").cast("string"), F.lit("@mail.example> .\n<< <urn:c"), F.col("c_custkey").cast("string"), F.lit("> foaf:name \"Other\" >> <urn:hasEnd> \"2004-06-30\" .\n"))
    return f.rdf_rows(p.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".ttl")).alias("path"), text.cast("binary").alias("content")))


def _export(s, d):
    facts = Views(s, d).facts().groupBy("contact_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value", "historical"))).alias("facts"))

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [[(x["kind"], x["value"], x["historical"]) for x in fs] for fs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([contact_formats.write_vcard(i, r) for i, r in zip(ids, rows)]), pa.array([contact_formats.write_turtle(i, r) for i, r in zip(ids, rows)]), pa.array([contact_formats.write_native({i: r}) for i, r in zip(ids, rows)])], names=["contact_id", "vcard", "turtle", "native"])

    return facts.mapInArrow(run, "contact_id string, vcard string, turtle string, native string")


def _participants(s, d):
    def run(path, content):
        m = mail.parse_message(content)
        for role, n, token, digest, name, raw in mail.participants({"from": m["from"], "to": m["to"], "cc": m["cc"]}):
            yield path, role, n, token, digest, name

    return f._mapped(f.archive_messages(_mbox_files(s, d)).select(F.col("external_id").alias("path"), F.col("message").alias("content")), run, "external_id string, role string, ordinal int, token string, token_hash string, display string")


QUERIES = {
    "html_to_text": _html,
    "embedding_segments": _segments,
    "mbox_split": lambda s, d: f.archive_messages(_mbox_files(s, d)),
    "mime_parse": lambda s, d: f.messages(f.archive_messages(_mbox_files(s, d))),
    "mail_participants": _participants,
    "vcard_parse": _vcards,
    "csv_contacts": _csvs,
    "csv_dialects": _dialects,
    "rdf_parse": _rdf,
    "contact_export": _export,
}
SQL = {
    "mail_participants": """WITH e AS (SELECT 'mail/box-' || conv_id || '.mbox#' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS external_id, role AS r FROM conversations)
SELECT external_id, role, CAST(ordinal AS INTEGER) AS ordinal, token, sha256(token) AS token_hash, display FROM (SELECT external_id, 'from' AS role, 0 AS ordinal, r || '@mail.example' AS token, r AS display FROM e UNION ALL SELECT external_id, 'to', 0, 'all@mail.example', 'All' FROM e UNION ALL SELECT external_id, 'to', 1, 'second@mail.example', '' FROM e)""",
    "csv_dialects": """WITH p AS (SELECT ['linkedin-connections', 'google-contacts', 'outlook-contacts', 'yahoo-contacts', 'simple-name-email', 'linkedin-section'][CAST(c_custkey % 6 AS INTEGER) + 1] AS dialect, c_custkey, c_name, c_custkey // 600 AS part FROM customer),
q AS (SELECT dialect || '-' || part AS path, dialect, 'row-' || (row_number() OVER (PARTITION BY dialect, part ORDER BY c_custkey) - 1) AS record, c_name, c_custkey FROM p)
SELECT DISTINCT path, '' AS record, 'dialect' AS kind, dialect AS value FROM q UNION ALL SELECT DISTINCT path, '', 'unmapped', 'Shoe' FROM q WHERE dialect = 'google-contacts'
UNION ALL SELECT path, record, 'name', 'Person ' || c_name FROM q WHERE dialect <> 'linkedin-section' UNION ALL SELECT path, record, 'email', 'p' || c_custkey || '@mail.example' FROM q WHERE dialect <> 'linkedin-section'
UNION ALL SELECT path, record, 'note', '2020' FROM q WHERE dialect = 'linkedin-connections' UNION ALL SELECT path, record, 'address', 'Road' FROM q WHERE dialect = 'outlook-contacts' UNION ALL SELECT path, record, 'expertise', c_name FROM q WHERE dialect = 'linkedin-section'""",
    "csv_contacts": """WITH p AS (SELECT c_mktsegment || '-' || (c_custkey // 200) || '.csv' AS path, 'row-' || (row_number() OVER (PARTITION BY c_mktsegment, c_custkey // 200 ORDER BY c_custkey) - 1) AS record, c_name, c_custkey FROM customer)
SELECT path, record, 'name' AS kind, 'Person ' || c_name AS value FROM p UNION ALL SELECT path, record, 'email', 'p' || c_custkey || '@mail.example' FROM p UNION ALL SELECT path, record, 'affiliation', 'Works' FROM p""",
    "vcard_parse": """WITH p AS (SELECT 'c' || c_custkey AS record, c_name, c_mktsegment, c_custkey FROM customer)
SELECT record || '.vcf' AS path, record, unnest(['identifier', 'name', 'affiliation', 'email', 'note']) AS kind, unnest([record, c_name, c_mktsegment, 'person' || c_custkey || '@mail.example', 'a folded line, with a comma']) AS value FROM p""",
}
