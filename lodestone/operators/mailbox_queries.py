"""Registered mailbox queries, and their DuckDB SQL."""

from __future__ import annotations

from lodestone.operators import mailbox as m
from lodestone.plans.views import Views, with_views

_q = lambda f, *a, **k: lambda spark, sf_dir: f(Views(spark, sf_dir), *a, **k)

QUERIES = {
    "mailboxes": _q(m.mailboxes, ["spam"]),
    "mailbox_counts": _q(m.mailbox_counts, ["inbox", "sent", "trash", "nowhere"]),
    "email_states": _q(m.email_states),
    "email_query": _q(m.email_query, mailbox="inbox", has="$seen", lacks="$flagged", after="2024-01-02 00:00:00", before="2024-01-15 00:00:00", limit=1000),
    "email_query_text": _q(m.email_query, text="the", limit=200),
    "threads": _q(m.threads),
    "blob_lookup": _q(m.blob_lookup),
    "default_mailboxes": _q(m.default_mailboxes),
    "mailbox_catalog": _q(m.catalog_problems, [("inbox", "Mine", ""), ("a", "Work", ""), ("b", "work", ""), ("c", "X", "zz"), ("d", "Y", "d"), ("a", "Other", "b")]),
}
SQL = {
    "mailboxes": "SELECT id, upper(id[1]) || id[2:] AS name, CAST(o AS INTEGER) AS sort_order FROM (SELECT unnest(['inbox','archive','sent','drafts','trash','spam','all','starred','unread']) AS id, unnest(range(9)) AS o) WHERE id <> 'spam'",
    "mailbox_counts": with_views("emails", "SELECT id, coalesce(n, 0) AS emails, coalesce(u, 0) AS unread FROM (VALUES ('inbox'), ('sent'), ('trash'), ('nowhere')) a(id) LEFT JOIN (SELECT mailbox, count(*) AS n, count(*) FILTER (WHERE NOT list_contains(keywords, '$seen')) AS u FROM emails GROUP BY 1) ON mailbox = id"),
    "email_states": with_views("emails", "SELECT email_id, thread_id, received_at, array_to_string(list_sort([mailbox, 'all']), ',') AS mailboxes, array_to_string(list_sort(keywords), ',') AS keywords FROM emails"),
    "email_query": with_views("emails", "SELECT email_id, thread_id, received_at, count(*) OVER () AS total_count FROM emails WHERE mailbox = 'inbox' AND list_contains(keywords, '$seen') AND NOT list_contains(keywords, '$flagged') AND received_at >= TIMESTAMP '2024-01-02' AND received_at < TIMESTAMP '2024-01-15' ORDER BY received_at DESC NULLS LAST, email_id LIMIT 1000"),
    "email_query_text": with_views("emails", r"SELECT email_id, thread_id, received_at, count(*) OVER () AS total_count FROM emails WHERE ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' LIKE '% the %' ORDER BY received_at DESC NULLS LAST, email_id LIMIT 200"),
    "threads": with_views("emails", "SELECT thread_id, string_agg(email_id, ',' ORDER BY received_at NULLS LAST, email_id) AS emails, count(*) AS n FROM emails GROUP BY 1"),
    "blob_lookup": """WITH RECURSIVE e AS (SELECT 'turn:' || conv_id || ':' || turn AS s, 'conv:' || conv_id AS t FROM conversations UNION ALL SELECT DISTINCT 'conv:' || conv_id, 'binder:' || (conv_id % 7) FROM conversations UNION ALL VALUES ('binder:3', 'conv:3'), ('binder:3', 'binder:4')),
r AS (SELECT 'turn:' || conv_id || ':' || turn AS seed, 'turn:' || conv_id || ':' || turn AS node FROM conversations UNION SELECT r.seed, e.t FROM r JOIN e ON e.s = r.node)
SELECT seed, node FROM r WHERE seed <> node""",
    "default_mailboxes": """SELECT doc_id, 'all,' || CASE WHEN doc_id % 11 = 0 THEN 'trash' WHEN doc_id % 7 = 0 THEN 'spam' WHEN doc_id % 5 = 0 THEN 'sent' WHEN doc_id % 2 = 0 THEN 'inbox' ELSE 'archive' END AS mailboxes,
concat_ws(',', CASE WHEN doc_id % 13 = 0 THEN '$flagged' END, CASE WHEN doc_id % 3 <> 0 THEN '$seen' END) AS keywords FROM documents""",
    "mailbox_catalog": "SELECT * FROM (VALUES ('inbox', 'system id'), ('a', 'repeated id'), ('a', 'repeated name'), ('d', 'own parent'), ('c', 'unknown parent')) x(id, problem)",
}
