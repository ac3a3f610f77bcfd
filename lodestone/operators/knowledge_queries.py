"""Registered queries of typed statements, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import structured as st
from lodestone.functions import vocabulary as vo
from lodestone.operators import knowledge as k
from lodestone.plans.views import Views


def _facts(v: Views):
    s = k.statements(v)
    return k.facts(s, k.selected(s, k.policies(v)).select("source", "contact"))


def _timed(v: Views):
    s = k.statements(v)
    return k.timed_facts(s, k.selected(s, k.policies(v)).select("source", "contact"), k.annotations(s))


def _headers(s, d):
    docs = Views(s, d).table("documents")
    n = F.col("doc_id").cast("string")
    stored = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('[{"name": "x-ID", "value": "'), n, F.lit('"}, {"name": " ", "value": "gone"}, {"name": "SUBJECT", "value": "two"}, {"name": "X-id", "value": "again"}]')))
    stored = stored.when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"reply-to": "a'), n, F.lit('@x", "from": "b"}'))).otherwise(F.concat(F.lit("Subject: Hello\r\n there\r\nto: c"), n, F.lit("\r\nTo: d\r\n")))
    return docs.select("doc_id", st.header_text(stored).alias("headers"))


def _texts(s, d):
    v = Views(s, d)
    pages = v.table("pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), st.text_of(F.concat(F.lit("<p>page&nbsp;"), F.col("page_id").cast("string"), F.lit("</p><script>x < 1</script> <b>a &amp;lt;</b><!-- note -->")), F.lit("text/HTML; charset=utf-8")).alias("text"))
    docs = v.table("documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), st.text_of(F.concat(F.lit("From: a\r\nTo: b\r\n\r\n body  of "), F.col("doc_id").cast("string"), F.lit("\n\n end ")), F.when(F.col("doc_id") % 2 == 0, "message/rfc822").otherwise("text/plain")).alias("text"))
    return pages.unionByName(docs)


def _patches(s, d):
    docs = Views(s, d).table("documents")
    return docs.select("doc_id", st.line_patch(F.concat(F.lit("same\n\n"), F.col("lang")), F.concat(F.lit("same\n"), F.col("source"))).alias("patch"))


def _paths(s, d):
    o = Views(s, d).table("orders")
    path = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("old/box."), (F.col("o_orderkey") % 9).cast("string"), F.lit("/cur/m.eml"))
    return o.select("o_orderkey", st.archive_mailbox(path, "maildir").alias("maildir"), st.archive_mailbox(F.concat(F.lit("a.b/in"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".mbox")), "mbox").alias("mbox"), st.archive_mailbox(F.when(F.col("o_orderkey") % 2 == 0, "x.eml").otherwise("y/x.eml"), "eml-dir").alias("folder"), st.archive_id(path, F.col("o_orderkey") % 3).alias("external_id"))


def _nul(s, d):
    docs = Views(s, d).table("documents")
    slashes = F.element_at(F.array(F.lit("\\u0000"), F.lit("\\\\u0000"), F.lit("\\\\\\u0000"), F.lit("\\u0000\\u0000")), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select("doc_id", st.without_nul(F.concat(F.lit('{"t": "a'), slashes, F.col("lang"), F.lit('"}'))).alias("json"))


QUERIES = {
    "statements": lambda s, d: k.statements(Views(s, d)),
    "contact_types": lambda s, d: k.typed_contacts(k.statements(Views(s, d))),
    "contact_selection": lambda s, d: k.selected(k.statements(Views(s, d)), k.policies(Views(s, d))),
    "facts_from_statements": lambda s, d: _facts(Views(s, d)),
    "annotated_facts": lambda s, d: _timed(Views(s, d)),
    "concept_claims": lambda s, d: k.concept_claims(k.statements(Views(s, d))),
    "card_concepts": lambda s, d: k.card_concepts(k.card_values(Views(s, d))),
    "bearing_validity": lambda s, d: k.validity(*k.timed(Views(s, d))),
    "alias_owners": lambda s, d: k.alias_owners(k.statements(Views(s, d))),
    "canonical_emit": lambda s, d: k.emitted(Views(s, d)),
    "stored_headers": _headers, "text_by_media_type": _texts, "line_patch": _patches, "archive_paths": _paths, "json_without_nul": _nul,
}


def _values(rows, name: str, columns: str) -> str:
    lit = lambda x: str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


_ME, _ADDR, _NAME = "'contact:c' || c_custkey", "'urn:addr:' || c_custkey", "'urn:name:' || c_custkey"
_ROWS = [
    (_ME, vo.RDF_TYPE, f"CASE c_custkey % 4 WHEN 0 THEN '{vo.iri('foaf:Person')}' WHEN 1 THEN 'http://schema.org/Person' WHEN 2 THEN '{vo.iri('schema:Organization')}' ELSE 'urn:other:Thing' END", "iri", "true"),
    (_ME, "http://schema.org/name", "' ' || c_name", "literal", "true"), (_ME, vo.iri("foaf:mbox"), "CASE WHEN c_custkey % 50 = 0 THEN 'nowhere' ELSE 'mailto:P' || c_custkey || '@Mail.Example' END", "iri", "true"),
    (_ME, vo.iri("schema:worksFor"), "c_mktsegment", "literal", "true"), (_ME, vo.iri("own:historicalEmail"), "'p' || c_custkey || '@old.example'", "literal", "true"),
    (_ME, vo.iri("own:hasContactPoint"), _ADDR, "iri", "true"), (_ADDR, vo.iri("own:addressLocality"), "n_name", "literal", "true"), (_ADDR, vo.iri("own:countryCode"), "' '", "literal", "true"),
    (_ME, vo.iri("own:hasName"), _NAME, "iri", "true"), (_NAME, vo.iri("own:fullName"), "upper(c_name)", "literal", "true"), (_NAME, vo.iri("own:displayable"), "'False'", "literal", "c_custkey % 7 = 0"),
    (_ME, vo.iri("foaf:knows"), "'contact:c' || (c_custkey + 40)", "iri", "true"), (_ME, vo.iri("foaf:age"), "'42'", "literal", "true"),
]
_ST = "st AS (" + " UNION ALL ".join(f"SELECT 'bundle:' || (c_custkey % 40) AS source, {s} AS subject, '{p}' AS predicate, {o} AS object, '{kind}' AS object_kind FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {when}" for s, p, o, kind, when in _ROWS) + ")"
_CANON = "regexp_replace(trim({}), '^http://schema\\.org/', 'https://schema.org/')".format
_TYPED = f"ty AS (SELECT DISTINCT source, subject AS contact FROM st WHERE predicate = '{vo.RDF_TYPE}' AND {_CANON('object')} IN ({', '.join(repr(t) for t in vo.entity_types())}))"
_SELECTED = f"""{_TYPED}, po AS (SELECT 'bundle:' || i AS source, i, i % 3 = 1 AS infer FROM range(40) r(i)),
ex AS (SELECT source, unnest(['contact:c' || i, 'contact:guest']) AS contact FROM po WHERE i % 3 = 0),
ro AS (SELECT ty.* FROM ty JOIN po USING (source) WHERE infer AND NOT EXISTS (SELECT 1 FROM st WHERE st.source = ty.source AND st.object = ty.contact)),
sel AS (SELECT *, 'explicit' AS rule FROM ex UNION ALL SELECT *, 'inferred' FROM ro UNION ALL SELECT *, 'typed' FROM ty WHERE source NOT IN (SELECT source FROM ex UNION SELECT source FROM ro))"""
_MAIL = "lower(trim(regexp_replace(trim(object), '^(mailto:|MAILTO:)', '')))"
_PARTS = [(vo.iri("own:streetAddress"), "CASE WHEN s_suppkey % 3 = 0 THEN 'Street ' || s_suppkey ELSE 'Only Street ' || s_suppkey END", "true"), (vo.iri("own:addressLocality"), "'Town'", "s_suppkey % 3 = 0"), (vo.iri("own:postalCode"), "lpad(CAST(s_suppkey AS VARCHAR), 5, '0')", "s_suppkey % 3 = 0"), (vo.iri("own:countryCode"), "'XX'", "s_suppkey % 3 = 0")]
_PLACE = "CASE WHEN s_suppkey % 3 = 0 THEN ';;Street ' || s_suppkey || ';Town; ;' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || ';XX' ELSE 'Only Street ' || s_suppkey END"
_NODE = f"'urn:addr:' || left(sha256(lower({_PLACE})), 16)"
_SPOT = "'urn:place:' || left(sha256((s_suppkey % 90) || '.5,-' || (s_suppkey % 180)), 16)"
_DAY, _LATER = "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')"
SQL = {
    "statements": f"WITH {_ST} SELECT * FROM st",
    "contact_types": f"WITH {_ST}, {_TYPED} SELECT * FROM ty",
    "contact_selection": f"WITH {_ST}, {_SELECTED} SELECT * FROM sel",
    "annotated_facts": f"""WITH {_ST}, {_SELECTED}, {_values(vo.fact_kinds(), 'fk', 'known, kind, historical')},
ow AS (SELECT st.source, object AS subject, max(subject) AS owner FROM st JOIN sel ON sel.source = st.source AND sel.contact = st.subject WHERE object_kind = 'iri' AND regexp_matches(object, '^urn:(addr|place|name):') GROUP BY 1, 2 UNION ALL SELECT DISTINCT source, contact, contact FROM sel),
r AS (SELECT st.source, owner AS contact, kind, CASE WHEN kind = 'email' THEN CASE WHEN regexp_matches({_MAIL}, '^.+@[^@]+$') THEN {_MAIL} ELSE '' END ELSE trim(object) END AS value, predicate, historical,
  predicate IN ('{vo.iri('foaf:mbox')}', '{vo.iri('schema:worksFor')}') AS noted, CAST(regexp_extract(st.subject, '([0-9]+)$', 1) AS BIGINT) AS k FROM st JOIN ow ON ow.source = st.source AND ow.subject = st.subject JOIN fk ON known = {_CANON('predicate')}
WHERE NOT EXISTS (SELECT 1 FROM st h WHERE h.source = st.source AND h.subject = st.subject AND h.predicate = '{vo.iri('own:displayable')}' AND lower(trim(h.object)) = 'false')),
t AS (SELECT source, contact, kind, value, predicate, historical, CASE WHEN noted AND k % 5 = 0 THEN '2001' WHEN noted AND k % 5 = 1 THEN '1999' ELSE '' END AS valid_from, CASE WHEN noted AND k % 10 = 0 THEN '2010' ELSE '' END AS valid_until FROM r WHERE value <> '')
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY contact, kind, value ORDER BY valid_until <> '' DESC, valid_from <> '' DESC, historical, predicate, source, valid_until, valid_from) = 1""",
    "facts_from_statements": f"""WITH {_ST}, {_SELECTED}, {_values(vo.fact_kinds(), 'fk', 'known, kind, historical')},
ow AS (SELECT st.source, object AS subject, max(subject) AS owner FROM st JOIN sel ON sel.source = st.source AND sel.contact = st.subject WHERE object_kind = 'iri' AND regexp_matches(object, '^urn:(addr|place|name):') GROUP BY 1, 2 UNION ALL SELECT DISTINCT source, contact, contact FROM sel),
r AS (SELECT st.source, owner AS contact, kind, CASE WHEN kind = 'email' THEN CASE WHEN regexp_matches({_MAIL}, '^.+@[^@]+$') THEN {_MAIL} ELSE '' END ELSE trim(object) END AS value, predicate, historical FROM st JOIN ow ON ow.source = st.source AND ow.subject = st.subject JOIN fk ON known = {_CANON('predicate')}
WHERE NOT EXISTS (SELECT 1 FROM st h WHERE h.source = st.source AND h.subject = st.subject AND h.predicate = '{vo.iri('own:displayable')}' AND lower(trim(h.object)) = 'false'))
SELECT * FROM r WHERE value <> ''""",
    "concept_claims": f"""WITH {_ST}, {_values(vo.terms(), 'tm', 'known, concept, evidence, role, how')}, r AS (SELECT subject, concept, evidence, role, how, object FROM st JOIN tm ON known = {_CANON('predicate')}),
x AS (SELECT subject, CASE WHEN evidence = 'name' THEN 'name-token' ELSE concept END AS concept, evidence, role, unnest(CASE WHEN evidence = 'name' THEN string_split(replace(lower(object), '#', ' '), ' ') WHEN how = 'email' THEN [{_MAIL}] WHEN how = 'url' THEN [regexp_replace(lower(object), '/+$', '')] ELSE [lower(trim(object))] END) AS value FROM r)
SELECT DISTINCT * FROM x WHERE value <> ''""",
    "card_concepts": f"""WITH {_values(vo.card_properties(), 'cp', 'property, concept, service')}, n AS (SELECT property, row_number() OVER () - 1 AS i FROM (VALUES {', '.join(f"('{p}')" for p, _, _ in vo.card_properties())}, ('X-OTHER')) v(property)),
{_values(vo.SERVICES.items(), 'sv', 'scheme, home')}, {_values(vo.CLOSED.items(), 'cl', 'home, day')},
c AS (SELECT c_custkey AS card, property, ['skype:', 'XMPP:', 'other:', ''][c_custkey % 4 + 1] || 'handle' || c_custkey AS value FROM customer JOIN n ON i = c_custkey % {len(vo.card_properties()) + 1}),
r AS (SELECT card, property, concept, CASE WHEN service <> '' THEN service WHEN concept = 'account' THEN coalesce((SELECT home FROM sv WHERE scheme = lower(regexp_extract(value, '^([^:]*):', 1))), '') ELSE '' END AS service FROM c JOIN cp USING (property))
SELECT r.*, coalesce(day, '') AS until FROM r LEFT JOIN cl ON home = service""",
    "bearing_validity": f"""SELECT 'order:' || o_orderkey AS node,
CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 10 = 0 THEN '2001-02-01T00:00:00Z' WHEN o_orderkey % 5 = 1 THEN {_DAY} || 'T10:00:00Z' ELSE {_DAY} || 'T00:00:00Z' END AS valid_from,
CASE o_orderkey % 5 WHEN 0 THEN {_LATER} || 'T00:00:00Z' WHEN 2 THEN left({_LATER}, 4) || '-01-01T00:00:00Z' ELSE '' END AS valid_until FROM orders""",
    "alias_owners": "WITH c AS (SELECT lower(c_mktsegment) AS alias, 'contact:c' || c_custkey AS contact FROM customer) SELECT alias, contact, CASE WHEN contact = min(contact) OVER (PARTITION BY alias) THEN 'active' ELSE 'conflict' END AS state FROM c",
    "canonical_emit": f"""SELECT DISTINCT * FROM (SELECT 'contact:s' || s_suppkey AS subject, '{vo.iri('own:hasName')}' AS predicate, 'urn:name:s' || s_suppkey AS object FROM supplier
UNION ALL SELECT 'urn:name:s' || s_suppkey, '{vo.iri('own:fullName')}', 'Given Two M ' || s_name FROM supplier UNION ALL SELECT 'contact:s' || s_suppkey, '{vo.iri('own:hasContactPoint')}', {_NODE} FROM supplier
{' '.join(f"UNION ALL SELECT {_NODE}, '{p}', {value} FROM supplier WHERE {when}" for p, value, when in _PARTS)}
UNION ALL SELECT 'contact:s' || s_suppkey, '{vo.iri('own:locatedAt')}', {_SPOT} FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT {_SPOT}, '{vo.iri('own:latitude')}', (s_suppkey % 90) || '.5' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT {_SPOT}, '{vo.iri('own:longitude')}', '-' || (s_suppkey % 180) FROM supplier WHERE s_suppkey % 2 = 0)""",
    "stored_headers": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Subject: two' || chr(10) || 'X-Id: ' || doc_id || ' again' WHEN 1 THEN 'From: b' || chr(10) || 'Reply-To: a' || doc_id || '@x' ELSE 'Subject: Hello there' || chr(10) || 'To: c' || doc_id || ' d' END AS headers FROM documents""",
    "text_by_media_type": "SELECT 'page:' || page_id AS id, 'page ' || page_id || ' a &lt;' AS text FROM pages UNION ALL SELECT 'doc:' || doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'From: a To: b ' END || 'body of ' || doc_id || ' end' FROM documents",
    "line_patch": "SELECT doc_id, 'lodestone-patch-v1' || chr(10) || '--- canonical' || chr(10) || '+++ variant' || chr(10) || '-same' || chr(10) || '-' || lang || chr(10) || '+same' || chr(10) || '+' || source || chr(10) AS patch FROM documents",
    "archive_paths": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 9 AS VARCHAR) ELSE 'old/box.' || (o_orderkey % 9) END AS maildir, 'a.b/in' || (o_orderkey % 9) AS mbox, CASE WHEN o_orderkey % 2 = 0 THEN 'eml-dir' ELSE 'y' END AS folder,
CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'old/box.' END || (o_orderkey % 9) || '/cur/m.eml' || CASE WHEN o_orderkey % 3 > 0 THEN '#' || (o_orderkey % 3) ELSE '' END AS external_id FROM orders""",
    "json_without_nul": r"""SELECT doc_id, '{"t": "a' || CASE doc_id % 4 WHEN 1 THEN '\\u0000' WHEN 2 THEN '\\' ELSE '' END || lang || '"}' AS json FROM documents""",
}
