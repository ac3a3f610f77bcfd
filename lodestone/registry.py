"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from lodestone.operators import contact_queries, content_queries, format_queries, job_queries, knowledge_queries, mailbox_queries, projection_queries, record_queries, search_queries, state_queries, storage_queries, text_queries, vector_queries

_MODULES = [search_queries, vector_queries, contact_queries, mailbox_queries, text_queries, storage_queries, job_queries, format_queries, projection_queries, record_queries, knowledge_queries, state_queries, content_queries]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
