"""Registered projections of manifests, and their DuckDB SQL."""

from __future__ import annotations

from lodestone.plans import projection as p
from lodestone.plans.fixpoint import shared_dir
from lodestone.plans.views import Views


def _table(name):
    return lambda s, d: p.TABLES[name](p.manifests(Views(s, d)))


def _rebuild(s, d):
    import uuid

    return p.rebuild(p.manifests(Views(s, d)), f"{shared_dir(s)}/lodestone-projection-{uuid.uuid4().hex}")


QUERIES = {f"project_{name}": _table(name) for name in p.TABLES} | {
    "project_rebuild": _rebuild,
    "project_changed": lambda s, d: p.objects(p.manifests(Views(s, d)).where("updated > timestamp_ntz'2024-01-01 05:00:00'")),
    "merge_manifest_records": lambda s, d: p.merge(p.manifests(Views(s, d))),
    "search_text_truncated": lambda s, d: p.search_text(p.manifests(Views(s, d)), most=57),
}
_D = "d AS (SELECT *, sha256(coalesce(text, '')) AS digest, 'doc:' || doc_id AS object_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS day FROM documents WHERE doc_id % 97 <> 5), lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)"
_TEXT = "object_id || chr(10) || 'text/plain' || chr(10) || lang || chr(10) || lang || ' ' || source || ' ' || lang || chr(10) || left(text, 30) || chr(10) || 'document document lang:' || lang || ' document document' || chr(10) || 'corpus ' || source || ' ' || doc_id"
_COUNTS = ["objects", "facets", "provenance", "relationships", "parts", "analysis", "graph_edges", "graph_nodes", "keywords", "embeddings", "overlays", "summaries", "search_text", "findings"]
SQL = {
    "project_objects": f"WITH {_D} SELECT digest, object_id, 'text/plain' AS media_type, day AS created, day AS updated, left(text, 30) AS title FROM d",
    "project_changed": f"WITH {_D} SELECT digest, object_id, 'text/plain' AS media_type, day AS created, day AS updated, left(text, 30) AS title FROM d WHERE day > TIMESTAMP '2024-01-01 05:00:00'",
    "project_facets": f"WITH {_D} SELECT digest, object_id, 'document' AS kind, '2' AS version, 'chars=' || n_chars || ';source=' || source AS metadata FROM d UNION ALL SELECT digest, object_id, 'lang:' || lang, '1', 'lang=' || lang FROM d",
    "project_provenance": f"WITH {_D} SELECT digest, 'corpus' AS source_kind, source AS source_name, CAST(doc_id AS VARCHAR) AS external_id, '1' AS version FROM d",
    "project_relationships": f"WITH {_D} SELECT digest, 'from_source' AS type, object_id AS \"from\", 'source:' || source AS \"to\", '' AS role, 0 AS ord FROM d UNION SELECT digest, 'contains', digest, sha256('part:' || doc_id), 'body', 0 FROM d WHERE doc_id % 10 = 0 UNION SELECT digest, 'part_of', sha256('part:' || doc_id), digest, 'body', 0 FROM d WHERE doc_id % 10 = 0",
    "project_parts": f"WITH {_D} SELECT DISTINCT digest, sha256('part:' || doc_id) AS part_digest, 'body' AS role, 0 AS ord FROM d WHERE doc_id % 10 = 0",
    "project_analysis": f"WITH {_D} SELECT digest, object_id, 'quality' AS analyzer, '1' AS version, CASE WHEN quality = 0 THEN 'failed' ELSE 'complete' END AS status FROM d JOIN lab USING (doc_id) WHERE quality IS NOT NULL",
    "project_graph_edges": f"WITH {_D} SELECT DISTINCT digest, object_id AS subject, 'written_in' AS predicate, lang AS object FROM d",
    "project_graph_nodes": f"WITH {_D} SELECT object_id AS node FROM d UNION SELECT lang FROM d",
    "project_keywords": f"WITH {_D} SELECT DISTINCT digest, keyword FROM (SELECT digest, lang AS keyword FROM d UNION ALL SELECT digest, source FROM d)",
    "project_embeddings": f"WITH {_D} SELECT digest, object_id, 'hash' AS model, digest AS embedding_id, CASE WHEN doc_id % 7 <> 0 THEN 2 END AS dims FROM d",
    "project_overlays": f"WITH {_D} SELECT digest, object_id, 'seen=' || (doc_id % 2) || CASE WHEN toxic IS NOT NULL THEN ';toxic=' || toxic ELSE '' END AS overlay FROM d LEFT JOIN lab USING (doc_id)",
    "project_summaries": f"WITH {_D} SELECT digest, object_id, 'quality' AS kind, 'quality ' || quality AS summary FROM d JOIN lab USING (doc_id) WHERE quality IS NOT NULL",
    "project_search_text": f"WITH {_D} SELECT object_id, {_TEXT} AS search_text FROM d",
    "search_text_truncated": f"WITH {_D}, t AS (SELECT object_id, {_TEXT} AS x FROM d), c AS (SELECT object_id, i, x[i] AS ch, sum(strlen(x[i])) OVER (PARTITION BY object_id ORDER BY i) AS b FROM t, range(1, 58) r(i)) SELECT object_id, string_agg(ch, '' ORDER BY i) FILTER (WHERE b <= 57) AS search_text FROM c GROUP BY 1",
    "project_findings": "SELECT 'findings:' || sha256(text) AS key, 'doc:' || doc_id AS object_id, 'unreadable' AS state FROM documents WHERE doc_id % 97 = 5",
    "merge_manifest_records": f"WITH {_D}, o AS (SELECT sha256(coalesce(text, '')) AS digest, 'doc:' || doc_id AS object_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS day, lang FROM documents), h AS (SELECT digest, min(object_id) AS object_id, min(day) AS created, max(day) AS updated, string_agg(DISTINCT lang, ',' ORDER BY lang) AS roles, count(*) AS records FROM o GROUP BY digest), f AS (SELECT digest, string_agg(DISTINCT x, ',' ORDER BY x) AS facets, count(DISTINCT doc_id) AS sources FROM (SELECT digest, doc_id, 'document@2' AS x FROM d UNION ALL SELECT digest, doc_id, 'lang:' || lang || '@1' FROM d) GROUP BY digest) SELECT h.*, coalesce(facets, '') AS facets, coalesce(sources, 0) AS sources FROM h LEFT JOIN f USING (digest)",
}
SQL["project_rebuild"] = "WITH " + ", ".join(f"{n}_t AS ({SQL[f'project_{n}']})" for n in _COUNTS) + " " + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}_t" for n in _COUNTS)
