"""Registered queries that read stored content: text by media type, headers, patches, paths, JSON without NUL, identities, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import structured as st
from lodestone.functions.text import body_fingerprint
from lodestone.operators import job_queries, state, state_queries, store_verify
from lodestone.plans import change_index
from lodestone.plans.fixpoint import shared_dir
from lodestone.plans.views import Views
from lodestone.sources import paged
from lodestone.streaming import pipeline, stateful
from lodestone.streaming.import_queue import Queue


def object_text(v: Views) -> DataFrame:
    """id, n_chars, sha256 of the extracted text of every page, message and document, by its media type."""
    turn = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    one = lambda t, c, name, media: v.table(t).select(name.alias("id"), st.text_of(F.coalesce(F.col(c), F.lit("")), F.lit(media)).alias("t"))
    rows = one("pages", "html", F.concat(F.lit("page:"), F.col("page_id").cast("string")), "text/html; charset=utf-8").unionByName(one("conversations", "text", turn, "Message/RFC822")).unionByName(one("documents", "text", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), "text/plain"))
    return rows.select("id", F.length("t").alias("n_chars"), F.sha2(F.col("t").cast("binary"), 256).alias("sha256"))


def text_headers(v: Views) -> DataFrame:
    """doc_id, names, lines: the header lines (name: value) that documents hold, by capitalised name, and their digest."""
    d = v.table("documents").select("doc_id", st.stored_headers(F.coalesce("text", F.lit(""))).alias("h"))
    return d.where("size(h) > 0").select("doc_id", F.array_join(F.transform("h", lambda x: x["name"]), ",").alias("names"), F.sha2(F.array_join(F.transform("h", lambda x: F.concat(x["name"], F.lit("="), F.array_join(x["values"], "|"))), "\n").cast("binary"), 256).alias("lines"))


def turn_patches(v: Views) -> DataFrame:
    """conv_id, turn, n_chars, sha256 of the patch that leads from each message of a thread to the next."""
    c = v.table("conversations").withColumn("base", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("base is not null and text is not null")
    p = c.select("conv_id", "turn", st.line_patch(F.col("base"), F.col("text")).alias("p"))
    return p.select("conv_id", "turn", F.length("p").alias("n_chars"), F.sha2(F.col("p").cast("binary"), 256).alias("sha256"))


def page_mailboxes(v: Views) -> DataFrame:
    """page_id, and the mailbox of its address's path as a maildir, an mbox and a folder of messages, with its id in the archive."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/?([^?#]*)", 1)
    return v.table("pages").where("url is not null").select("page_id", *[st.archive_mailbox(path, k).alias(k) for k in ("maildir", "mbox", "nnml")], st.archive_id(path, F.col("page_id") % 3).alias("external_id"))


def json_texts(v: Views) -> DataFrame:
    """doc_id and the digest of each text after a way through JSON whose escapes of NUL are taken out. Texts stand with a NUL and an
    escaped escape behind them, so that every one holds both."""
    marked = F.concat(F.coalesce("text", F.lit("")), F.lit("\x00\\u0000"))
    back = F.from_json(st.without_nul(F.to_json(F.struct(marked.alias("t")))), "t string")["t"]
    return v.table("documents").select("doc_id", F.sha2(back.cast("binary"), 256).alias("sha256"))


def changed_by_index(v: Views, since: str) -> DataFrame:
    """user_id, changed_at of every user that changed after a time, through a change index that the first of two calls fills."""
    objects = v.table("events").groupBy(F.col("user_id").cast("string").alias("digest")).agg(F.max("ts").alias("changed_at")).withColumn("findings", F.array().cast("array<string>"))
    log = f"{shared_dir(v.spark)}/lodestone-changes-{uuid.uuid4().hex}"
    change_index.changed(objects, log, since)
    return change_index.changed(objects, log, since).select(F.col("digest").cast("bigint").alias("user_id"), "changed_at")


def pulled(v: Views) -> DataFrame:
    """message_id, thread_id, sha256 of all messages, published as pages of a mail service and pulled from it by a stream."""
    base = f"{shared_dir(v.spark)}/lodestone-service-{uuid.uuid4().hex}"
    name = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    c = v.table("conversations").select(name.alias("message_id"), F.col("conv_id").cast("bigint").alias("thread_id"), "role", "text", F.struct("conv_id", "turn").alias("sent"))
    paged.publish(c, f"{base}/service", 0, per_page=20_000)
    return paged.pull(v.spark, f"{base}/service", f"{base}/pulled").select("message_id", "thread_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


def imported(v: Views) -> DataFrame:
    """item, status, attempts, outcome of all documents through an import queue in three batches; the outcome is a text's body fingerprint,
    and empty texts fail until they are dead."""
    d = v.table("documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("item"), F.col("doc_id").alias("ord"), "text")
    queue = Queue(v.spark, f"{shared_dir(v.spark)}/lodestone-queue-{uuid.uuid4().hex}")
    queue.discover(d)
    fingerprints = lambda taken: taken.select("item").join(d.where("coalesce(text, '') != ''"), "item").select("item", body_fingerprint("text").alias("outcome"))
    return queue.run(fingerprints, batch=max(1, -(-d.count() // 3))).select("item", "status", "attempts", "outcome")


def _streamed(kind: str):
    return lambda s, d: stateful.run_stateful(pipeline.changes(s, d), kind, f"{shared_dir(s)}/lodestone-stream-{uuid.uuid4().hex}")


_q = lambda f, *a: lambda spark, sf_dir: f(Views(spark, sf_dir), *a)
QUERIES = {
    "object_text": _q(object_text), "text_headers": _q(text_headers), "turn_patches": _q(turn_patches), "page_mailboxes": _q(page_mailboxes), "json_texts": _q(json_texts),
    "identity_of_message": _q(state.identity_of, 0), "changed_by_index": _q(changed_by_index, "2024-01-15 00:00:00"), "paged_pull": _q(pulled), "import_queue_run": _q(imported), "store_findings": _q(store_verify.store_findings),
    "stream_retry_schedule": _streamed("retries"), "stream_breaker_state": _streamed("breakers"), "stream_claims": _streamed("claims"),
}

_CLEAN = r"trim(regexp_replace({}, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))"
_BARE = r"regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _s in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_e}', '{_s}')"
_BODY = r"CASE WHEN regexp_matches(text, '\r?\n\r?\n') THEN substring(text, length(regexp_extract(text, '(?s)^(.*?)\r?\n\r?\n', 1)) + 1) ELSE coalesce(text, '') END"
_FINGERPRINT = r"sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))), lambda x: x <> ''), chr(10)))"
_FIRST = "sha256(trim(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')))"
SQL = {
    "object_text": f"""SELECT id, length(t) AS n_chars, sha256(t) AS sha256 FROM (
SELECT 'page:' || page_id AS id, {_CLEAN.format(_BARE)} AS t FROM pages
UNION ALL SELECT 'turn:' || conv_id || ':' || turn, {_CLEAN.format(_BODY)} FROM conversations
UNION ALL SELECT 'doc:' || doc_id, {_CLEAN.format("coalesce(text, '')")} FROM documents)""",
    "text_headers": r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\r?\n[ \t]+', ' ', 'g'), '\r?\n')) AS x, generate_subscripts(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\r?\n[ \t]+', ' ', 'g'), '\r?\n'), 1) AS i FROM documents),
h AS (SELECT doc_id, i, array_to_string(list_transform(string_split(lower(regexp_extract(x, '^([^:]+):', 1)), '-'), lambda p: upper(left(p, 1)) || substring(p, 2)), '-') AS name, trim(regexp_replace(x, '^[^:]+:', '')) AS value FROM l WHERE regexp_matches(x, '^[!-9;-~]+:')),
n AS (SELECT doc_id, name, string_agg(value, '|' ORDER BY i) AS vs FROM h GROUP BY ALL)
SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names, sha256(string_agg(name || '=' || vs, chr(10) ORDER BY name)) AS lines FROM n GROUP BY doc_id""",
    "turn_patches": """WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS base FROM conversations),
p AS (SELECT conv_id, turn, 'lodestone-patch-v1' || chr(10) || '--- canonical' || chr(10) || '+++ variant' || chr(10)
  || array_to_string(list_transform(list_filter(string_split(base, chr(10)), lambda x: x <> ''), lambda x: '-' || x || chr(10)), '') || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: '+' || x || chr(10)), '') AS p FROM c WHERE base IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, turn, length(p) AS n_chars, sha256(p) AS sha256 FROM p""",
    "page_mailboxes": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/?([^?#]*)', 1) AS p FROM pages WHERE url IS NOT NULL)
SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(p, '^(.*)/[^/]*$', 1), '^(.*)/[^/]*$', 1), ''), 'maildir') AS maildir, regexp_replace(p, '\.[^./]*$', '') AS mbox, coalesce(nullif(regexp_extract(p, '^(.*)/[^/]*$', 1), ''), 'nnml') AS nnml,
  CASE WHEN page_id % 3 > 0 THEN p || '#' || (page_id % 3) ELSE p END AS external_id FROM p""",
    "json_texts": r"""SELECT doc_id, sha256(replace(coalesce(text, ''), chr(0), '') || '\u0000') AS sha256 FROM documents""",
    "identity_of_message": f"WITH d AS (SELECT DISTINCT sha256(coalesce(text, '')) AS digest FROM documents WHERE {_FIRST} IN (SELECT {_FIRST} FROM documents WHERE doc_id = 0)) SELECT digest, (SELECT count(*) FROM d) AS total_count FROM d ORDER BY digest LIMIT 50",
    "import_queue_run": f"""SELECT 'doc:' || doc_id AS item, CASE WHEN coalesce(text, '') = '' THEN 'dead' ELSE 'done' END AS status, CASE WHEN coalesce(text, '') = '' THEN 3 ELSE 1 END AS attempts, CASE WHEN coalesce(text, '') <> '' THEN {_FINGERPRINT} END AS outcome FROM documents""",
    "changed_by_index": "SELECT user_id, max(ts) AS changed_at FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-15 00:00:00'",
    "paged_pull": "SELECT 'turn:' || conv_id || ':' || turn AS message_id, CAST(conv_id AS BIGINT) AS thread_id, sha256(coalesce(text, '')) AS sha256 FROM conversations",
}
_j, _s = job_queries.SQL, state_queries.SQL
SQL |= {"stream_retry_schedule": _j["retry_schedule"], "stream_claims": _s["ingest_claims"]} | store_verify.SQL
