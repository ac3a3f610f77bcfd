"""Registered queries of search, and their DuckDB SQL."""

from __future__ import annotations

from lodestone.operators import search as s
from lodestone.plans.stored import stored
from lodestone.plans.views import Views, with_views

_q = lambda f, *a, **k: lambda spark, sf_dir: f(Views(spark, sf_dir), *a, **k)
_stored = lambda f, *a, **k: lambda spark, sf_dir: f(stored(Views(spark, sf_dir)), *a, **k)

QUERIES = {
    "object_breakdown_totals": _q(s.breakdown_totals),
    "breakdown_by_facet": _q(s.breakdown, "facet"),
    "breakdown_by_media_type": _q(s.breakdown, "media_type"),
    "breakdown_by_source": _q(s.breakdown, "source"),
    "breakdown_by_analyzer": _q(s.breakdown, "analyzer"),
    "breakdown_by_identity": _q(s.breakdown, "identity"),
    "search_facets_media": _stored(s.search, facets=["lang:en", "mail_message"], media_types=["text/plain", "message/rfc822"], limit=100),
    "search_text_and": _stored(s.search, text="the and thing", limit=1000),
    "search_text_phrase": _stored(s.search, text='"of the"', limit=1000),
    "search_text_or_not": _stored(s.search, text="trash or moron -the", limit=1000),
    "search_provenance_independent": _stored(s.search, source_kinds=["corpus"], source_names=["src1", "src2"], limit=500),
    "search_paged_total": _stored(s.search, facets=["document"], limit=25, offset=50),
    "search_part_role": _stored(s.search, part_role="system", limit=1000),
    "search_analyzer": _stored(s.search, analyzer="toxicity", limit=1000),
    "search_relationship_same_row": _q(s.search_related, "contains", "R"),
    "structure_parts_by_role": _q(s.structure),
    "relationships_filter": _q(s.relationships, ["located_in", "part_of"], limit=1000),
    "relationships_either_end": _q(s.relationships, either=["nation:3", "customer:7"], limit=1000),
    "graph_node": _q(s.graph, "nation:5", limit=1000),
    "graph_two_hop": _q(s.hops, ["located_in", "part_of"]),
    "graph_three_hop": _q(s.hops, ["placed_by", "located_in", "part_of"]),
    "analysis_status": _q(s.analysis_status, ["quality"], ["failed"]),
    "analysis_required": _q(s.analysis_required, [("quality", "1"), ("toxicity", "2"), ("summary", "1")]),
    "latest_analysis": _q(s.latest_analysis),
    "projected_at": _q(s.projected_at),
    "source_cursors": _q(s.source_cursors),
    "identity_missing_live": _q(s.identity_missing_live),
    "fused_search": _q(s.fused_search, "thing", limit=100),
    "search_snippet": _q(s.snippets, "idiot"),
}

_TOK = r"' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' '"
_BODY = r"sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))), lambda x: x <> ''), chr(10)))"


def _search(where: str, limit: int, offset: int = 0, need: str = "") -> str:
    return with_views(f"objects facets {need}", f"""
SELECT digest, object_id, media_type, total_count, facets, 1.0::DOUBLE AS score FROM (
  SELECT digest, object_id, media_type, count(*) OVER () AS total_count FROM objects o WHERE {where} ORDER BY object_id, digest LIMIT {limit} OFFSET {offset}) p
LEFT JOIN (SELECT digest, string_agg(kind, ',' ORDER BY kind) AS facets FROM facets GROUP BY digest) f USING (digest)""")


def _text(where: str) -> str:
    return _search(f"""digest IN (SELECT sha256(text) FROM (SELECT text, {_TOK} AS t FROM documents UNION ALL SELECT text, {_TOK} FROM conversations) WHERE {where})""", 1000)


_FACET_JOIN = "(SELECT digest, string_agg(kind, ',' ORDER BY kind) AS facets FROM facets GROUP BY digest)"
_escape = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')".format

SQL = {
    "object_breakdown_totals": with_views("objects analysis", "SELECT count(*) AS objects, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE compound) AS compound, count(*) FILTER (WHERE NOT compound) AS simple, count(*) FILTER (WHERE digest IN (SELECT digest FROM analysis)) AS analysed FROM objects"),
    "breakdown_by_facet": with_views("facets", "SELECT kind AS label, count(DISTINCT digest) AS n FROM facets GROUP BY kind"),
    "breakdown_by_media_type": with_views("objects", "SELECT media_type AS label, count(*) AS n FROM objects GROUP BY media_type"),
    "breakdown_by_source": with_views("provenance", "SELECT source_name AS label, count(DISTINCT digest) AS n FROM provenance GROUP BY source_name"),
    "breakdown_by_analyzer": with_views("analysis", "SELECT analyzer AS label, count(DISTINCT digest) AS n FROM analysis GROUP BY analyzer"),
    "breakdown_by_identity": with_views("provenance", "SELECT source_kind AS label, count(DISTINCT digest) AS n FROM provenance GROUP BY source_kind"),
    "search_facets_media": _search("media_type IN ('text/plain', 'message/rfc822') AND EXISTS (SELECT 1 FROM facets f WHERE f.digest = o.digest AND kind IN ('lang:en', 'mail_message'))", 100),
    "search_text_and": _text("t LIKE '% the %' AND t LIKE '% and %' AND t LIKE '% thing %'"),
    "search_text_phrase": _text("t LIKE '% of the %'"),
    "search_text_or_not": _text("t LIKE '% trash %' OR (t LIKE '% moron %' AND t NOT LIKE '% the %')"),
    "search_provenance_independent": _search("EXISTS (SELECT 1 FROM provenance p WHERE p.digest = o.digest AND source_kind = 'corpus') AND EXISTS (SELECT 1 FROM provenance p WHERE p.digest = o.digest AND source_name IN ('src1', 'src2'))", 500, need="provenance"),
    "search_paged_total": _search("EXISTS (SELECT 1 FROM facets f WHERE f.digest = o.digest AND kind = 'document')", 25, 50),
    "search_part_role": _search("digest IN (SELECT digest FROM parts WHERE role = 'system')", 1000, need="parts"),
    "search_analyzer": _search("digest IN (SELECT digest FROM analysis WHERE analyzer = 'toxicity')", 1000, need="analysis"),
    "search_relationship_same_row": with_views("relationships", "SELECT DISTINCT from_id FROM relationships WHERE rel_type = 'contains' AND role = 'R'"),
    "structure_parts_by_role": with_views("parts facets", f"SELECT p.digest, role, ord, part_digest, coalesce(facets, '') AS facets FROM parts p LEFT JOIN {_FACET_JOIN} f ON f.digest = p.part_digest"),
    "relationships_filter": with_views("relationships", "SELECT * FROM relationships WHERE rel_type IN ('located_in', 'part_of') ORDER BY rel_type, from_id, to_id, role LIMIT 1000"),
    "relationships_either_end": with_views("relationships", "SELECT * FROM relationships WHERE from_id IN ('nation:3', 'customer:7') OR to_id IN ('nation:3', 'customer:7') ORDER BY rel_type, from_id, to_id, role LIMIT 1000"),
    "graph_node": with_views("relationships", "SELECT from_id AS subject, rel_type AS predicate, to_id AS object FROM relationships WHERE from_id = 'nation:5' OR to_id = 'nation:5' ORDER BY 1, 2, 3 LIMIT 1000"),
    "graph_two_hop": with_views("relationships", "SELECT a.from_id AS start, b.to_id AS \"end\", count(*) AS paths FROM relationships a JOIN relationships b ON a.to_id = b.from_id WHERE a.rel_type = 'located_in' AND b.rel_type = 'part_of' GROUP BY 1, 2"),
    "graph_three_hop": with_views("relationships", "SELECT a.from_id AS start, c.to_id AS \"end\", count(*) AS paths FROM relationships a JOIN relationships b ON a.to_id = b.from_id JOIN relationships c ON b.to_id = c.from_id WHERE a.rel_type = 'placed_by' AND b.rel_type = 'located_in' AND c.rel_type = 'part_of' GROUP BY 1, 2"),
    "analysis_status": with_views("analysis", "SELECT digest, analyzer, version, status FROM analysis WHERE analyzer = 'quality' AND status = 'failed'"),
    "analysis_required": with_views("objects analysis", "SELECT o.digest, s.analyzer, s.required, CASE WHEN a.version IS NULL THEN 'missing' WHEN a.version <> s.required THEN 'stale' ELSE a.status END AS status FROM objects o CROSS JOIN (VALUES ('quality', '1'), ('toxicity', '2'), ('summary', '1')) s(analyzer, required) LEFT JOIN analysis a ON a.digest = o.digest AND a.analyzer = s.analyzer"),
    "latest_analysis": with_views("analysis", "SELECT digest, analyzer, generated FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY generated DESC, analyzer) AS rk FROM analysis) WHERE rk = 1"),
    "projected_at": "SELECT sha256(coalesce(text, '')) AS digest, max(doc_id) AS last FROM documents GROUP BY 1",
    "source_cursors": "SELECT source AS source_name, count(*) AS records, max(doc_id) AS position FROM documents GROUP BY source",
    "identity_missing_live": f"""WITH d AS (SELECT doc_id, source, lang, {_BODY} AS identity, sha256(text) AS digest FROM documents)
SELECT identity, min(digest) AS digest, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, bool_or(lang = 'en') AS english, count(DISTINCT digest) AS versions,
  max(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END) AS scale, string_agg(DISTINCT source, ',' ORDER BY source) FILTER (WHERE lang <> 'en') AS variant_sources
FROM d WHERE source <> 'src0' AND identity NOT IN (SELECT identity FROM d WHERE source = 'src0') GROUP BY identity""",
    "fused_search": f"""WITH d AS (SELECT sha256(text) AS digest, source, n_chars FROM documents WHERE {_TOK} LIKE '% thing %'),
u AS (SELECT digest, 1.0::DOUBLE AS score, 'index' AS origin FROM d UNION ALL SELECT digest, CASE WHEN n_chars < 500 THEN 1.5 ELSE 0.5 END, 'live' FROM d WHERE source = 'src0')
SELECT digest, max(score) AS score, string_agg(DISTINCT origin, '+' ORDER BY origin) AS origins FROM u GROUP BY digest ORDER BY score DESC, digest LIMIT 100""",
    "search_snippet": rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\x0b\x0c]+', ' ', 'g')) AS t FROM documents),
h AS (SELECT doc_id, t, strpos(lower(t), 'idiot') AS pos FROM d), w AS (SELECT *, greatest(1, pos - 80) AS s, least(length(t) + 1, pos + 5 + 120) AS e FROM h WHERE pos > 0)
SELECT doc_id, trim(CASE WHEN s > 1 THEN '...' ELSE '' END || {_escape('substring(t, s, pos - s)')} || '<mark>' || {_escape('substring(t, pos, 5)')} || '</mark>' || {_escape('substring(t, pos + 5, greatest(0, e - pos - 5))')} || CASE WHEN e <= length(t) THEN '...' ELSE '' END) AS snippet FROM w""",
}
