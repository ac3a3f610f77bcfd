"""Registered storage queries, and their DuckDB SQL."""

from __future__ import annotations

from lodestone.operators import storage as s
from lodestone.plans.views import Views, with_views

_q = lambda f, *a, **k: lambda spark, sf_dir: f(Views(spark, sf_dir), *a, **k)

QUERIES = {
    "cdc_chunks": _q(s.chunks), "chunk_dedup_stats": _q(s.chunk_stats), "gc_live_dead": _q(s.collect_garbage), "delete_import": _q(s.delete_import, "src3"), "repack_ratio": _q(s.repack),
    "verify_findings": _q(s.verify, ("user", "assistant")), "storage_breakdown": _q(s.storage_breakdown), "source_lookup": _q(s.source_lookup), "import_decisions": _q(s.import_decisions), "import_dedupe_report": _q(s.import_report),
    "manifest_merge": _q(s.merge_manifests), "dictionary_samples": _q(s.training_samples),
}
_RECIPES = "rc AS (SELECT o_orderkey AS recipe, epoch(o_orderdate) AS updated, o_orderstatus <> 'F' AS has_manifest, o_orderkey % 17 = 0 AS annotation, l_partkey AS chunk, CAST(l_quantity AS BIGINT) AS bytes FROM orders JOIN lineitem ON l_orderkey = o_orderkey), gc AS (SELECT chunk, CASE WHEN bool_or(live) THEN 'live' ELSE 'dead' END AS state, count(*) FILTER (WHERE NOT live) AS orphan_refs FROM (SELECT *, has_manifest OR annotation OR updated >= (SELECT max(epoch(o_orderdate)) FROM orders) - 900 AS live FROM rc) GROUP BY chunk)"
_BODY = r"sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))), lambda x: x <> ''), chr(10)))"
_DECISIONS = f"""d AS (SELECT doc_id, CASE WHEN regexp_matches(lower(split_part(text, chr(10), 1)), '[a-z]') THEN sha256(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))) ELSE 'doc:' || doc_id END AS message, {_BODY} AS body, lang, length(text) AS size FROM documents),
f AS (SELECT *, row_number() OVER w AS rn, first(lang) OVER w AS first_lang, max(size) OVER (PARTITION BY message ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest, row_number() OVER (PARTITION BY message, body ORDER BY doc_id) > 1 AS seen FROM d WINDOW w AS (PARTITION BY message ORDER BY doc_id)),
r AS (SELECT doc_id, CASE WHEN rn = 1 THEN 'canonical' WHEN seen THEN 'id_duplicate' WHEN lang IS NOT DISTINCT FROM first_lang THEN 'variant_minor' ELSE 'variant_major' END AS decision, rn > 1 AND NOT seen AND size > longest AS promoted FROM f)"""
SQL = {
    "gc_live_dead": f"WITH {_RECIPES} SELECT * FROM gc",
    "delete_import": "SELECT digest, CASE WHEN o THEN 'detached' ELSE 'deleted' END AS outcome FROM (SELECT sha256(text) AS digest, bool_or(source = 'src3') AS h, bool_or(source <> 'src3') AS o FROM documents GROUP BY 1) WHERE h",
    "repack_ratio": f"WITH {_RECIPES}, s AS (SELECT chunk, max(bytes) AS bytes FROM rc GROUP BY chunk) SELECT chunk % 32 AS pack, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(coalesce(sum(bytes) FILTER (WHERE state = 'live'), 0) AS BIGINT) AS live_bytes, round(coalesce(sum(bytes) FILTER (WHERE state = 'live'), 0) / sum(bytes), 6) AS ratio FROM s JOIN gc USING (chunk) GROUP BY 1",
    "verify_findings": with_views("objects parts facets provenance", """SELECT digest, 'manifest_missing_facets' AS code FROM objects WHERE digest NOT IN (SELECT digest FROM facets)
UNION SELECT digest, 'compound_dangling_part' FROM parts WHERE part_digest NOT IN (SELECT digest FROM objects WHERE object_id LIKE 'turn:%') UNION SELECT digest, 'compound_invalid_part' FROM parts WHERE role IS NULL OR role NOT IN ('user', 'assistant') OR ord < 0
UNION SELECT digest, 'source_index_missing' FROM objects WHERE NOT compound AND digest NOT IN (SELECT digest FROM provenance) UNION SELECT sha256(text), 'blob_digest_mismatch' FROM documents WHERE n_chars <> length(text)
UNION SELECT digest, 'blob_read_failed' FROM objects WHERE bytes = 0 AND NOT compound"""),
    "storage_breakdown": with_views("objects parts", "SELECT role, CAST(sum(uses) AS BIGINT) AS parts, count(*) AS objects, CAST(sum(uses * bytes) AS BIGINT) AS bytes, CAST(sum(bytes) AS BIGINT) AS unique_bytes FROM (SELECT role, part_digest, count(*) AS uses, max(bytes) AS bytes FROM parts p JOIN objects o ON o.digest = p.part_digest GROUP BY 1, 2) GROUP BY role"),
    "source_lookup": r"""WITH st AS (SELECT regexp_replace(url, '\?.*$', '') AS ref, CAST(page_id % 3 AS INTEGER) AS version, sha256(html) AS digest, page_id FROM pages),
a AS (SELECT ref, version FROM (SELECT DISTINCT ref FROM st), (VALUES (0), (1), (2)) v(version))
SELECT a.ref, CAST(a.version AS INTEGER) AS version, coalesce((SELECT arg_max(digest, page_id) FROM st WHERE st.ref = a.ref AND st.version = a.version), (SELECT arg_max(digest, page_id) FROM st WHERE st.ref = a.ref)) AS digest FROM a""",
    "import_decisions": f"WITH {_DECISIONS} SELECT * FROM r",
    "import_dedupe_report": f"WITH {_DECISIONS} SELECT decision, count(*) AS n, count(*) FILTER (WHERE promoted) AS promoted FROM r GROUP BY decision",
    "manifest_merge": "SELECT sha256(text) AS digest, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT lang, ',' ORDER BY lang) AS roles, arg_max(source, doc_id) AS last_source, arg_min(source, doc_id) AS first_source, max(n_chars) AS version_count, max(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END) AS scale, count(*) AS records FROM documents GROUP BY 1",
    "dictionary_samples": with_views("objects", "SELECT media_type, count(*) AS samples, CAST(sum(least(bytes, 16384)) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY digest) AS rn FROM objects WHERE bytes > 0) WHERE rn <= 1024 GROUP BY 1 HAVING count(*) >= 16"),
}
