"""Registered queries of resolution, jobs and streams, and their DuckDB SQL."""

from __future__ import annotations

from lodestone.operators import jobs as j
from lodestone.operators import repair
from lodestone.operators import resolve as r
from lodestone.plans.views import Views, with_views
from lodestone.streaming import pipeline

_q = lambda f, *a, **k: lambda spark, sf_dir: f(Views(spark, sf_dir), *a, **k)


QUERIES = {
    "claim_omega": _q(r.claim_idf), "blocking_candidates": _q(r.blocking), "iddiff_edges": _q(r.scored_edges), "repair_clusters": _q(r.clusters), "resolve_greedy": _q(r.resolve_by_component), "observation_keys": _q(r.observation_keys), "knn_candidates": _q(repair.all_candidates), "repair_rounds": _q(repair.all_repaired),
    "job_derivation": _q(j.derive), "job_derivation_forced": _q(j.derive, forced=["outline"]), "reconcile_pending": _q(j.reconcile), "retry_schedule": _q(j.retries), "backpressure_state": _q(j.backpressure, 5, 0), "breaker_state": _q(j.breaker_states),
    "changed_since": _q(j.changed_since, "2024-01-15 00:00:00"), "sweep_chunk": _q(j.sweep, "4"), "ops_status": _q(j.ops_status),
    "batch_projection": lambda s, d: j.project_events(Views(s, d).table("events")), "stream_projection": pipeline.projection, "stream_dedup_window_counts": pipeline.windowed_counts,
}
_CLAIMS = """claims AS (
  SELECT 'c' || c_custkey AS entity, 'email' AS attr, 'p' || (c_custkey % 500) || '@mail.example' AS value, 'set' AS kind FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'phone', '555' || lpad(CAST(c_custkey % 700 AS VARCHAR), 4, '0'), 'set' FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'account', CASE WHEN c_custkey % 3 = 0 THEN 'own-' || c_custkey ELSE 'acct-' || (c_custkey % 500) END, 'functional' FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'affiliation', c_mktsegment, 'contextual' FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'name', 'given' || (c_custkey % 500), 'name' FROM customer)"""
_JOBS = """SELECT digest, analyzer, want AS version, reason, CASE reason WHEN 'forced' THEN 2 WHEN 'repair' THEN 1 ELSE 0 END AS priority, sha256(digest || chr(0) || analyzer || chr(0) || want) AS job_key FROM (
SELECT o.digest, s.analyzer, s.want, CASE WHEN {} THEN 'forced' WHEN a.version IS NULL THEN 'missing' WHEN a.version <> s.want THEN 'stale' WHEN a.status IN ('failed', 'error', 'invalid') THEN 'repair' END AS reason
FROM objects o CROSS JOIN (VALUES ('quality', '1', ['text/plain']), ('toxicity', '2', ['text/plain', 'message/rfc822']), ('outline', '1', CAST([] AS VARCHAR[]))) s(analyzer, want, media)
LEFT JOIN analysis a ON a.digest = o.digest AND a.analyzer = s.analyzer WHERE len(s.media) = 0 OR list_contains(s.media, o.media_type)) WHERE reason IS NOT NULL"""
_LATEST = "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1"
SQL = {
    "claim_omega": f"""WITH {_CLAIMS}, n AS (SELECT count(DISTINCT entity) AS n FROM claims), f AS (SELECT attr, value, kind, count(DISTINCT entity) AS df FROM claims GROUP BY ALL), i AS (SELECT attr, value, kind, df, greatest(0.0, ln((1 + n) / (1 + df))) AS idf FROM f, n)
SELECT attr, value, df, round(idf, 6) AS idf, round(CASE kind WHEN 'functional' THEN 1.0 + idf WHEN 'set' THEN 0.5 + 0.7 * idf WHEN 'name' THEN 0.15 + 0.3 * idf ELSE 0.05 + 0.15 * least(idf, 1.0) END, 6) AS omega FROM i""",
    "blocking_candidates": f"""WITH {_CLAIMS}, c AS (SELECT DISTINCT entity, attr, value FROM claims WHERE attr IN ('account', 'email', 'phone')),
h AS (SELECT entity, attr, value FROM c JOIN (SELECT attr, value FROM c GROUP BY 1, 2 HAVING count(*) > 1) USING (attr, value)),
s AS (SELECT entity, string_agg(attr || chr(0) || value, chr(10) ORDER BY attr, value) AS held FROM h GROUP BY entity),
k AS (SELECT entity, min(entity) OVER (PARTITION BY held) AS class, count(*) OVER (PARTITION BY held) AS n FROM s), r AS (SELECT class, n, attr, value FROM k JOIN h USING (entity) WHERE entity = class)
SELECT 'member' AS part, entity AS a, class AS b, NULL AS shared FROM k
UNION ALL SELECT 'pair', x.class, y.class, string_agg(DISTINCT x.attr, ',' ORDER BY x.attr) FROM r x JOIN r y ON x.attr = y.attr AND x.value = y.value AND (x.class < y.class OR (x.class = y.class AND x.n > 1)) GROUP BY 2, 3""",
    "observation_keys": f"WITH {_CLAIMS} SELECT entity, sha256(string_agg(h, chr(10) ORDER BY h)) AS key FROM (SELECT entity, sha256(attr || chr(0) || value) AS h FROM claims) GROUP BY entity",
    "job_derivation": with_views("objects analysis", _JOBS.format("false")),
    "job_derivation_forced": with_views("objects analysis", _JOBS.format("s.analyzer = 'outline'")),
    "reconcile_pending": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) SELECT CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 120) THEN 'satisfied' WHEN rn > 1 THEN 'duplicate' ELSE 'kept' END AS outcome, count(*) AS n FROM p GROUP BY 1",
    "retry_schedule": """WITH o AS (SELECT event_id, user_id, ts, event_type <> 'purchase' AS ok, sum(CAST(event_type <> 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
f AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS attempt FROM o WHERE NOT ok)
SELECT event_id, CAST(attempt AS INTEGER) AS attempt, CASE WHEN attempt > 5 THEN 'dead_letter' ELSE 'retry' END AS action, CASE WHEN attempt <= 5 THEN CAST(10 * pow(2, attempt - 1) AS BIGINT) END AS delay FROM f""",
    "backpressure_state": """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) AS delta FROM events GROUP BY ALL), d AS (SELECT event_type, hour, CAST(sum(delta) OVER (PARTITION BY event_type ORDER BY hour) AS BIGINT) AS depth FROM h)
SELECT event_type, hour, depth, coalesce(last_value(CASE WHEN depth >= 5 THEN true WHEN depth <= 0 THEN false END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING), false) AS paused FROM d""",
    "changed_since": "SELECT user_id, max(ts) AS changed_at, count(*) AS changes FROM events WHERE ts > TIMESTAMP '2024-01-15' GROUP BY user_id",
    "sweep_chunk": with_views("objects", "SELECT digest, media_type FROM objects WHERE digest >= '4' ORDER BY digest LIMIT 200"),
    "ops_status": "SELECT event_type AS queue, count(*) AS depth, min(ts) AS oldest FROM events GROUP BY 1",
    "batch_projection": _LATEST,
    "stream_projection": _LATEST,
    "stream_dedup_window_counts": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY ALL",
}
