"""Registered queries of state, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import state as s
from lodestone.operators.job_queries import _JOBS
from lodestone.plans.views import Views, with_views

_q = lambda f, *a, **k: lambda spark, sf_dir: f(Views(spark, sf_dir), *a, **k)
IDS = ["turn:0:0", "turn:3:1", "turn:999999999:0", "turn:3:1", "nothing"]


def _updated(v: Views):
    states = v.emails().select("email_id", F.array_sort(F.array("mailbox", F.lit("all"))).alias("mailboxes"), F.array_sort("keywords").alias("keywords"))
    return s.updated_emails(states, s.email_updates(v))


def _claims(v: Views):
    return s.granted_claims(v.table("events").select(F.col("user_id").alias("ref"), F.col("event_id").alias("id"), F.col("ts").alias("at")))


_some = lambda v: v.table("pages").where("page_id < 40").select(v.digest(F.col("html")).alias("digest"))
QUERIES = {
    "email_state_update": lambda sp, d: _updated(Views(sp, d)), "emails_requested": _q(s.requested_emails, IDS), "project_object": lambda sp, d: s.project_object(Views(sp, d), _some(Views(sp, d))),
    "cursor_upsert": lambda sp, d: s.cursors(s.cursor_reports(Views(sp, d))), "ingest_claims": lambda sp, d: _claims(Views(sp, d)), "contact_embedding_store": lambda sp, d: s.stored_embeddings(s.embedding_upserts(Views(sp, d))),
    "annotation_merge": lambda sp, d: s.merged_annotations(s.annotation_rows(Views(sp, d))), "mail_manifest_merge": _q(s.merged_records), "delete_import_report": _q(s.delete_report, "src3"),
    "delete_object": lambda sp, d: s.delete_object(Views(sp, d), _some(Views(sp, d))), "parent_summaries": _q(s.parent_summaries), "compound_parents": _q(s.compound_parents), "storage_recursive": _q(s.recursive_storage),
    "worker_branches": _q(s.worker_branches), "backfill_page": _q(s.backfill_page, ("src1", 100), 500), "import_queue_state": _q(s.import_queue), "metrics_snapshot": _q(s.metrics), "identity_resolve": _q(s.resolved_identity, " DOC-thean "),
}
_TURN = "'turn:' || conv_id || ':' || turn"
SQL = {
    "email_state_update": with_views("emails", """WITH u AS (SELECT event_id AS p, 'turn:' || (user_id % 60) || ':' || (event_id % 12) AS email_id, CASE WHEN value > 100 THEN '' WHEN value > 50 THEN 'all,archive' ELSE 'inbox' END AS m, CASE WHEN user_id % 2 = 0 THEN '$flagged,$seen' ELSE '' END AS k FROM events WHERE event_type = 'click'),
l AS (SELECT email_id, arg_max(m, p) FILTER (WHERE m <> '') AS m, arg_max(k, p) FILTER (WHERE m <> '') AS k, count(*) FILTER (WHERE m <> '') AS sequence, count(*) FILTER (WHERE m = '') AS rejected FROM u GROUP BY 1)
SELECT email_id, coalesce(m, array_to_string(list_sort([mailbox, 'all']), ',')) AS mailboxes, coalesce(k, array_to_string(list_sort(keywords), ',')) AS keywords, coalesce(sequence, 0) AS sequence, coalesce(rejected, 0) AS rejected FROM emails LEFT JOIN l USING (email_id)"""),
    "emails_requested": with_views("emails", "SELECT id, email_id IS NOT NULL AS found, thread_id, mailbox FROM (VALUES ('turn:0:0'), ('turn:3:1'), ('turn:999999999:0'), ('nothing')) a(id) LEFT JOIN emails ON email_id = id"),
    "project_object": with_views("objects facets provenance", """WITH a AS (SELECT DISTINCT sha256(coalesce(html, '')) AS digest FROM pages WHERE page_id < 40)
SELECT digest, object_id, media_type, coalesce((SELECT string_agg(kind, ',' ORDER BY kind) FROM facets f WHERE f.digest = o.digest), '') AS facets, (SELECT count(*) FROM provenance p WHERE p.digest = o.digest) AS sources FROM objects o JOIN a USING (digest)"""),
    "cursor_upsert": "SELECT source_name, source_kind, cursor, updated FROM (SELECT 'source' || (user_id % 20) AS source_name, event_type AS source_kind, event_id AS cursor, ts AS updated, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "ingest_claims": """WITH RECURSIVE e AS (SELECT user_id AS ref, event_id AS id, ts AS claimed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT ref, id, claimed, i FROM e WHERE i = 1 UNION ALL SELECT ref, id, claimed, i FROM (SELECT e.*, row_number() OVER (PARTITION BY e.ref ORDER BY e.i) AS k FROM r JOIN e ON e.ref = r.ref AND e.claimed > r.claimed + INTERVAL 15 MINUTE) WHERE k = 1)
SELECT ref, id, claimed FROM r""",
    "contact_embedding_store": "SELECT contact_id, model, contact_id || ':' || model || ':' || vec_id AS embedding_id, dims FROM (SELECT 'contact:c' || (vec_id % 50) AS contact_id, 'm' || (vec_id % 3) AS model, vec_id, CAST(len(embedding) AS INTEGER) AS dims, row_number() OVER (PARTITION BY vec_id % 50, vec_id % 3 ORDER BY vec_id DESC) AS rn FROM embeddings) WHERE rn = 1 AND vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND dims > 0",
    "annotation_merge": """WITH r AS (SELECT sha256(coalesce(text, '')) AS digest, doc_id, coalesce(CAST(quality AS VARCHAR), 'none') AS q, coalesce(CAST(toxic AS VARCHAR), 'none') AS t FROM labels JOIN documents USING (doc_id)),
a AS (SELECT digest, doc_id * 2 AS p, 'failed' AS status, q, NULL AS t FROM r UNION ALL SELECT digest, doc_id * 2 + 1, CASE WHEN doc_id % 3 = 1 THEN 'complete' ELSE 'skipped' END, NULL, t FROM r WHERE doc_id % 3 <> 0)
SELECT digest, 'analysis' AS kind, 'quality' AS analyzer, concat_ws(';', 'quality=' || arg_max(q, p) FILTER (WHERE q IS NOT NULL), 'status=' || arg_max(status, p), 'toxic=' || arg_max(t, p) FILTER (WHERE t IS NOT NULL)) AS data, arg_max(status, p) IN ('complete', 'skipped') AS satisfied FROM a GROUP BY digest""",
    "mail_manifest_merge": """WITH d AS (SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS digest FROM documents), h AS (SELECT digest, max(doc_id % 5) AS version_count, ['trivial', 'minor', 'major'][max(doc_id % 3) + 1] AS max_scale, bool_or(doc_id % 4 = 0) AS collision, arg_max(doc_id, (doc_id % 5) * 1000000000000 + doc_id) AS canonical, arg_max(lang, doc_id) AS body FROM d GROUP BY digest),
p AS (SELECT digest, string_agg(x, ',' ORDER BY x) AS sources FROM (SELECT digest, source || '/' || (doc_id % 2) || '/' || min(doc_id) AS x FROM d GROUP BY digest, source, doc_id % 2) GROUP BY digest),
s AS (SELECT digest, string_agg(x, ',' ORDER BY x) AS parts FROM (SELECT digest, 'body:0:' || max(doc_id) AS x FROM d GROUP BY digest UNION ALL SELECT digest, 'attachment:' || (doc_id % 2) || ':' || max(doc_id) FROM d GROUP BY digest, doc_id % 2) GROUP BY digest)
SELECT * FROM h JOIN p USING (digest) JOIN s USING (digest)""",
    "delete_import_report": "SELECT count(*) AS scanned, count(*) FILTER (WHERE own > 0 AND others = 0) AS deleted, CAST(sum(own) AS BIGINT) AS detached FROM (SELECT sha256(coalesce(text, '')) AS digest, count(*) FILTER (WHERE source = 'src3') AS own, count(*) FILTER (WHERE source <> 'src3') AS others FROM documents GROUP BY 1)",
    "delete_object": with_views("objects analysis", r"""WITH g AS (SELECT DISTINCT sha256(coalesce(html, '')) AS digest FROM pages WHERE page_id < 40), al AS (SELECT regexp_replace(url, '\?.*$', '') AS ref, arg_max(sha256(coalesce(html, '')), page_id) AS digest FROM pages GROUP BY 1)
SELECT digest, 'manifest' AS kind, count(*) AS rows FROM objects JOIN g USING (digest) GROUP BY digest UNION ALL SELECT digest, 'annotation', count(*) FROM analysis JOIN g USING (digest) GROUP BY digest UNION ALL SELECT digest, 'source_index', count(*) FROM al JOIN g USING (digest) GROUP BY digest"""),
    "parent_summaries": with_views("analysis", "SELECT parent, part, analyzer, version, status FROM (SELECT DISTINCT 'source:' || source AS parent, sha256(coalesce(text, '')) AS part FROM documents) p JOIN analysis a ON a.digest = p.part"),
    "compound_parents": with_views("parts", "SELECT part_digest AS part, count(DISTINCT digest) AS parents, count(*) AS uses FROM parts GROUP BY 1"),
    "storage_recursive": f"""WITH RECURSIVE e AS (SELECT {_TURN} AS t, 'conv:' || conv_id AS s FROM conversations UNION SELECT 'conv:' || conv_id, 'binder:' || (conv_id % 7) FROM conversations UNION VALUES ('binder:3', 'conv:3'), ('binder:3', 'binder:4')),
r AS (SELECT DISTINCT s AS root, s AS node FROM e WHERE s LIKE 'binder:%' UNION SELECT r.root, e.t FROM r JOIN e ON e.s = r.node), z AS (SELECT {_TURN} AS node, max(strlen(coalesce(text, ''))) AS bytes FROM conversations GROUP BY 1)
SELECT root, count(*) AS objects, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM r LEFT JOIN z USING (node) WHERE root <> node GROUP BY root""",
    "worker_branches": with_views("objects analysis", f"""WITH due AS ({_JOBS.format("s.analyzer = 'toxicity'")}), q AS (SELECT digest, analyzer, version, reason FROM due UNION ALL SELECT sha256(coalesce(text, '')), 'quality', '1', 'missing' FROM benchmark UNION ALL SELECT digest, analyzer, version, 'missing' FROM analysis WHERE analyzer = 'quality' AND status = 'complete')
SELECT analyzer, CASE WHEN digest NOT IN (SELECT digest FROM objects) THEN 'dropped' WHEN analyzer = 'outline' THEN 'parked' WHEN reason <> 'forced' AND EXISTS (SELECT 1 FROM analysis a WHERE a.digest = q.digest AND a.analyzer = q.analyzer AND a.version = q.version AND a.status IN ('complete', 'skipped')) THEN 'skipped' ELSE 'run' END AS branch, count(*) AS n FROM q GROUP BY 1, 2"""),
    "backfill_page": "SELECT coalesce(source, '') AS source, doc_id FROM documents WHERE coalesce(source, '') > 'src1' OR (source = 'src1' AND doc_id > 100) ORDER BY 1, 2 LIMIT 500",
    "import_queue_state": """WITH e AS (SELECT user_id AS item, CASE WHEN event_type = 'purchase' THEN 'done' WHEN value > 100 THEN 'failed' ELSE 'running' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT item, CASE max(state) FILTER (WHERE rn = 1) WHEN 'running' THEN 'resume' ELSE max(state) FILTER (WHERE rn = 1) END AS state, count(*) FILTER (WHERE state = 'running') AS attempts FROM e GROUP BY item""",
    "metrics_snapshot": """WITH e AS (SELECT 'events_' || regexp_replace(lower(event_type), '[^a-z0-9_]', '_', 'g') AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT name || '_total' AS name, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY name UNION ALL SELECT name, value FROM e WHERE rn = 1 UNION ALL SELECT name || '_seconds_sum', round(sum(value), 4) FROM e GROUP BY name UNION ALL SELECT name || '_seconds_count', CAST(count(*) AS DOUBLE) FROM e GROUP BY name""",
    "identity_resolve": "WITH d AS (SELECT DISTINCT sha256(coalesce(text, '')) AS digest FROM documents WHERE lower('doc-' || regexp_replace(left(text, 6), '[^A-Za-z]', '', 'g')) = 'doc-thean') SELECT digest, (SELECT count(*) FROM d) AS total_count FROM d ORDER BY digest LIMIT 50",
}
