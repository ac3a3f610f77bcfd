"""Registered contact queries, and their DuckDB SQL."""

from __future__ import annotations

from lodestone.operators import contacts as c
from lodestone.operators.common import paged
from lodestone.plans.fixpoint import reachable
from lodestone.plans.views import Views, with_views

_q = lambda f, *a, **k: lambda spark, sf_dir: f(Views(spark, sf_dir), *a, **k)


def _subnodes(v: Views):
    from pyspark.sql import functions as F

    edges = v.relationships().where("rel_type in ('located_in', 'part_of')").select(F.col("from_id").alias("source"), F.col("to_id").alias("target"))
    back = edges.where("target like 'region:%'").select(F.col("target").alias("source"), F.col("source").alias("target")).where("source = 'region:1'")
    seeds = v.table("supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("seed"))
    return reachable(seeds, edges.unionByName(back), include_seeds=False)


QUERIES = {
    "rdf_statements": _q(c.statements),
    "rdf_terms": _q(c.terms),
    "contact_facts_project": _q(c.latest_fact),
    "contact_facts_current": lambda s, d: c.current(Views(s, d).facts()),
    "contact_facts_at": lambda s, d: c.as_of(Views(s, d).facts(), "1997"),
    "contact_facts_overlap": lambda s, d: c.overlapping(Views(s, d).facts(), "1995", "2001"),
    "contact_facts_page": lambda s, d: paged(Views(s, d).facts().select("contact_id", "kind", "value"), ["contact_id", "kind", "value"], 100, 10),
    "identity_bindings": _q(c.bindings),
    "identity_details": _q(c.identity_details, ["customer000000007@mail.example", "supplier000000003@trade.example"]),
    "alias_claims": _q(c.alias_claims),
    "resolve_contact_ref": _q(c.resolve, ["contact:c5", "Customer", "supplier", "nobody"]),
    "contact_rollups": _q(c.rollups),
    "contact_aggregate": _q(c.aggregate, ["contact:c1", "contact:s2", "contact:none"]),
    "contact_search": _q(c.search, "automobile", limit=500),
    "contact_neighborhood": _q(c.neighbourhood),
    "contact_analysis_inputs": _q(c.analysis_inputs),
    "contact_analysis_status": _q(c.analysis_status, ["missing", "stale"], limit=1000),
    "contact_messages": _q(c.messages, ["contact:c7", "contact:s3"], limit=1000),
    "contact_messages_role": _q(c.messages, ["contact:s3"], ["to"], limit=1000),
    "owned_subnodes": _q(_subnodes),
}
_BIND = "bindings AS (SELECT contact_id, lower(value) AS token, sha256(lower(value)) AS token_hash, bool_and(historical) AS historical FROM facts WHERE kind = 'email' GROUP BY 1, 2)"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\-_. ]', '', 'g'), '[\\-_. ]+', '-', 'g'), '^-|-$', '', 'g')".format
_STATE = "SELECT contact_id, sha256(string_agg(kind || '=' || value, ';' ORDER BY kind || '=' || value)) AS input_hash FROM facts GROUP BY 1"
_ALIAS = f"aliases AS (SELECT slug, min(contact_id) AS contact_id, count(*) AS claims FROM (SELECT contact_id, {_SLUG('regexp_replace(value, ' + chr(39) + '[0-9]{4,}' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS slug FROM facts WHERE kind IN ('name', 'alias')) WHERE slug <> '' GROUP BY slug)"
_ST = "st AS (SELECT DISTINCT contact_id AS subject, 'urn:fact:' || kind AS predicate, value AS object, sha256(contact_id || chr(0) || 'urn:fact:' || kind || chr(0) || value) AS statement_hash FROM facts)"
SQL = {
    "rdf_statements": with_views("facts", f"WITH {_ST} SELECT * FROM st"),
    "rdf_terms": with_views("facts", f"WITH {_ST} SELECT DISTINCT sha256(term_kind || chr(0) || value) AS term_key, term_kind, value FROM (SELECT 'iri' AS term_kind, subject AS value FROM st UNION ALL SELECT 'iri', predicate FROM st UNION ALL SELECT 'literal', object FROM st)"),
    "contact_facts_project": with_views("facts", "SELECT contact_id, kind, value, historical, valid_until FROM (SELECT *, row_number() OVER (PARTITION BY contact_id, kind, value ORDER BY valid_until <> '' DESC, valid_from <> '' DESC, historical) AS rk FROM facts) WHERE rk = 1"),
    "contact_facts_current": with_views("facts", "SELECT * FROM facts WHERE NOT historical AND valid_until = ''"),
    "contact_facts_at": with_views("facts", "SELECT * FROM facts WHERE (valid_from = '' OR valid_from <= '1997') AND (valid_until = '' OR valid_until >= '1997')"),
    "contact_facts_overlap": with_views("facts", "SELECT * FROM facts WHERE (valid_from = '' OR valid_from <= '2001') AND (valid_until = '' OR valid_until >= '1995')"),
    "contact_facts_page": with_views("facts", "SELECT contact_id, kind, value, (SELECT count(*) FROM facts) AS total_count FROM facts ORDER BY 1, 2, 3 LIMIT 100 OFFSET 10"),
    "identity_bindings": with_views("facts", f"WITH {_BIND} SELECT * FROM bindings"),
    "identity_details": with_views("facts", f"WITH {_BIND} SELECT * FROM bindings WHERE token IN ('customer000000007@mail.example', 'supplier000000003@trade.example')"),
    "alias_claims": with_views("facts", f"WITH {_ALIAS} SELECT * FROM aliases"),
    "resolve_contact_ref": with_views("facts", f"WITH {_ALIAS}, r(ref) AS (VALUES ('contact:c5'), ('Customer'), ('supplier'), ('nobody')) SELECT ref, coalesce(i.contact_id, a.contact_id, ref) AS contact_id FROM r LEFT JOIN (SELECT DISTINCT contact_id FROM facts) i ON i.contact_id = ref LEFT JOIN aliases a ON a.slug = {_SLUG('ref')}"),
    "contact_rollups": with_views("facts participants", f"""WITH {_BIND},
o AS (SELECT contact_id, min(message_time) AS first_message, max(message_time) AS last_message, count(DISTINCT message) AS messages, count(*) AS observations FROM (SELECT DISTINCT contact_id, token, token_hash FROM bindings) b JOIN participants p ON p.token = b.token AND p.token_hash = b.token_hash GROUP BY 1)
SELECT f.*, first_message, last_message, coalesce(messages, 0) AS messages, coalesce(observations, 0) AS observations FROM (
SELECT contact_id, coalesce(min(value) FILTER (WHERE kind = 'name'), min(value) FILTER (WHERE kind = 'alias'), contact_id) AS display_name,
 coalesce(min(value) FILTER (WHERE kind = 'email' AND NOT historical), min(value) FILTER (WHERE kind = 'email'), '') AS primary_email, count(*) AS fact_count,
 coalesce(max(try_cast(value AS INTEGER)) FILTER (WHERE kind = 'importance' AND regexp_full_match(value, '[0-9]+')), 0) AS importance, string_agg(value, ' ' ORDER BY kind, value) AS search_text
FROM facts GROUP BY contact_id) f LEFT JOIN o USING (contact_id)"""),
    "contact_aggregate": with_views("facts participants", f"""WITH {_BIND}, a(contact_id) AS (VALUES ('contact:c1'), ('contact:s2'), ('contact:none')),
o AS (SELECT contact_id, count(DISTINCT message) AS messages FROM bindings b JOIN participants p ON p.token = b.token GROUP BY 1),
n AS (SELECT contact_id, coalesce(min(value) FILTER (WHERE kind = 'name'), min(value) FILTER (WHERE kind = 'alias')) AS display_name, string_agg(kind || '=' || value, ';' ORDER BY kind, value) AS facts FROM facts GROUP BY 1)
SELECT contact_id, coalesce(display_name, '') AS display_name, coalesce(messages, 0) AS messages, coalesce(facts, '') AS facts FROM a LEFT JOIN n USING (contact_id) LEFT JOIN o USING (contact_id)"""),
    "contact_search": with_views("facts", r"""WITH b AS (SELECT contact_id, coalesce(min(value) FILTER (WHERE kind = 'name'), min(value) FILTER (WHERE kind = 'alias')) AS display_name, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(string_agg(value, ' ' ORDER BY kind, value)), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM facts GROUP BY 1)
SELECT contact_id, display_name, count(*) OVER () AS total_count FROM b WHERE t LIKE '% automobile %' ORDER BY display_name, contact_id LIMIT 500"""),
    "contact_neighborhood": with_views("facts", "SELECT contact_id, kind, value FROM facts WHERE kind IN ('affiliation', 'alias', 'identifier', 'relationship', 'title', 'url')"),
    "contact_analysis_inputs": with_views("facts", "SELECT contact_id, left(string_agg(kind || ': ' || value, chr(10) ORDER BY rn), 12000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY kind, value, historical) AS rn FROM facts) WHERE rn <= 200 GROUP BY contact_id"),
    "contact_analysis_status": with_views("facts", "WITH c AS (SELECT contact_id, CAST(regexp_extract(contact_id, '[0-9]+') AS BIGINT) AS n FROM facts GROUP BY 1), x AS (SELECT contact_id, CASE n % 3 WHEN 0 THEN 'missing' ELSE 'stale' END AS status, CASE WHEN n % 3 <> 0 THEN n END AS generated FROM c WHERE n % 3 <> 1) SELECT *, (SELECT count(*) FROM x) AS total_count FROM x ORDER BY generated DESC NULLS LAST, contact_id LIMIT 1000"),
    "contact_messages": with_views("facts participants", f"WITH {_BIND}, t AS (SELECT DISTINCT token FROM bindings WHERE contact_id IN ('contact:c7', 'contact:s3')) SELECT message, role, ordinal, token, message_time, count(*) OVER () AS total_count FROM participants JOIN t USING (token) ORDER BY message_time DESC NULLS LAST, message, role, ordinal, token LIMIT 1000"),
    "contact_messages_role": with_views("facts participants", f"WITH {_BIND}, t AS (SELECT DISTINCT token FROM bindings WHERE contact_id = 'contact:s3') SELECT message, role, ordinal, token, message_time, count(*) OVER () AS total_count FROM participants JOIN t USING (token) WHERE role = 'to' ORDER BY message_time DESC NULLS LAST, message, role, ordinal, token LIMIT 1000"),
    "owned_subnodes": with_views("relationships", "SELECT 1").replace("WITH relationships", "WITH RECURSIVE relationships").replace("SELECT 1", "").rstrip() + """,
e AS (SELECT from_id AS s, to_id AS t FROM relationships WHERE rel_type IN ('located_in', 'part_of') UNION ALL SELECT to_id, from_id FROM relationships WHERE rel_type = 'part_of' AND to_id = 'region:1'),
r AS (SELECT 'supplier:' || s_suppkey AS seed, 'supplier:' || s_suppkey AS node FROM supplier UNION SELECT r.seed, e.t FROM r JOIN e ON e.s = r.node)
SELECT seed, node FROM r WHERE seed <> node""",
}
