"""Registered record and discovery queries, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import discovery as d
from lodestone.operators import records as r
from lodestone.plans.views import Views, with_views

_q = lambda f, *a, **k: lambda spark, sf_dir: f(Views(spark, sf_dir), *a, **k)

QUERIES = {
    "claim_extraction": _q(r.extract_claims), "nickname_aliases": _q(r.nickname_aliases), "import_delta": _q(r.import_delta), "canonical_messages": _q(r.canonical_messages),
    "page_links": _q(r.page_links), "im_accounts": _q(r.accounts), "operations_joined": _q(r.operations), "message_summaries": _q(r.message_summaries),
    "category_discovery": lambda s, p: d.discover(Views(s, p).table("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")),
}
_FLAT = r"trim(regexp_replace({}, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))".format
SQL = {
    "claim_extraction": with_views("facts", r"""WITH f AS (SELECT contact_id, CASE kind WHEN 'alias' THEN 'name' ELSE kind END AS attr, CASE WHEN kind IN ('name', 'alias') THEN 'name' WHEN kind = 'email' THEN 'set' ELSE 'contextual' END AS evidence, kind, value FROM facts WHERE NOT historical AND kind IN ('name', 'alias', 'email', 'affiliation', 'title', 'address'))
SELECT DISTINCT contact_id, attr, evidence, value FROM (SELECT contact_id, attr, evidence, unnest(CASE WHEN evidence = 'name' THEN string_split(replace(lower(value), '#', ' '), ' ') ELSE [lower(value)] END) AS value FROM f) WHERE value <> ''"""),
    "nickname_aliases": "SELECT 'supplier:' || s_suppkey AS owner, n_name AS alias FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "canonical_messages": rf"SELECT 'turn:' || conv_id || ':' || turn AS email_id, left({_FLAT('text')}, 40) AS subject, sha256({_FLAT('text')}) AS body_hash, regexp_extract(text, 'https?://[^\s<>" + '"' + r"'')\]]+', 0) AS link, CASE WHEN turn > 0 THEN 'turn:' || conv_id || ':' || (turn - 1) END AS reply_to FROM conversations",
    "im_accounts": with_views("facts", "SELECT DISTINCT contact_id, left(value, length(value) - 12) AS account FROM facts WHERE kind = 'email' AND value LIKE '%@old.example'"),
    "message_summaries": with_views("emails", rf"SELECT email_id, thread_id, mailbox, left({_FLAT('text')}, 240) AS preview FROM emails WHERE ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' LIKE '% the %' ORDER BY email_id LIMIT 50"),
    "import_delta": with_views("facts", """WITH f AS (SELECT DISTINCT contact_id, kind, value FROM facts WHERE NOT (CAST(regexp_extract(contact_id, '[0-9]+') AS BIGINT) % 3 = 0 AND kind <> 'email')), l AS (SELECT contact_id, '<' || contact_id || '> <urn:fact:' || kind || '> "' || value || '" .' AS line FROM f)
SELECT contact_id, string_agg(line, chr(10) ORDER BY line) AS delta, count(*) AS statements FROM l GROUP BY 1"""),
    "page_links": r"""SELECT page_id, regexp_extract(html, 'https?://[^\s<>"'')\]]+', 0) AS link, regexp_extract(html, 'https?://[^\s<>"'')\]]+/(?:pull|pulls|merge_requests)/\d+', 0) AS review, regexp_extract(html, '(?m)^\s*@?([\w.-]+) (?:commented|approved|requested|pushed|merged|closed|opened)\b', 1) AS actor FROM pages""",
    "operations_joined": "SELECT sha256(user_id || chr(0) || event_type || chr(0) || strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')) AS request, min(event_id) AS operation, count(*) - 1 AS joined FROM events GROUP BY 1",
}
