"""Registered queries of the text functions and analyzers, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.categories import RULES, categories, dictionary_family
from lodestone.plans.views import Views, with_views

_docs = lambda cols: lambda s, d: Views(s, d).table("documents").select("doc_id", *cols())  # noqa: E731  columns need a session


def _phones(s, d):
    c = Views(s, d).table("customer")
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, "+1 (").otherwise("("), F.lpad((F.col("c_custkey") * 7919 % 1000).cast("string"), 3, "0"), F.lit(") 555-"), F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")))
    return c.select("c_custkey", t.phone(raw).alias("phone"))


def _names(s, d):
    c = Views(s, d).table("customer")
    title = F.element_at(F.array(F.lit("Dr. "), F.lit("Mrs "), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select("c_custkey", F.array_join(t.name_tokens(F.concat(title, F.regexp_replace("c_name", "#", " No "), F.when(F.col("c_custkey") % 4 == 0, ", Jr.").otherwise(""))), "|").alias("tokens"))


def _message(s, d):
    c = Views(s, d).table("conversations")
    mid = F.concat(F.lit(" <MSG-"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("@Host.Example> "))
    return c.select("conv_id", "turn", t.message_id(mid).alias("message_id"), t.message_fingerprint(mid, F.substring("text", 1, 40), F.col("role"), F.lit("all"), F.col("text")).alias("fingerprint"))


def _categories(s, d):
    docs = Views(s, d).table("documents")
    sender = F.element_at(F.array(F.lit("a@github.com"), F.lit("News Daily <daily@paper.example>"), F.lit("b@linkedin.com"), F.lit("c@mail.example"), F.lit("gitlab@mg.gitlab.com")), (F.col("doc_id") % 5 + 1).cast("int"))
    subject = F.element_at(F.array(F.lit("Weekly statement"), F.lit("Run failed: pipeline"), F.lit("Hello"), F.lit("Appointment")), (F.col("doc_id") % 4 + 1).cast("int"))
    labels = F.when(F.col("doc_id") % 6 == 0, "CATEGORY_UPDATES").when(F.col("doc_id") % 6 == 1, "1work").otherwise("")
    return docs.select("doc_id", F.array_join(categories(sender, subject, F.lit(""), F.col("text"), labels), ",").alias("categories"))


def _families(s, d):
    media = F.element_at(F.array(*[F.lit(x) for x in ("text/plain; charset=utf-8", "text/html", "application/json", "application/x+xml", "TEXT/CSV", "image/png", "", "text/markdown")]), (F.col("doc_id") % 8 + 1).cast("int"))
    role = F.element_at(F.array(*[F.lit(x) for x in ("", "body", "headers")]), (F.col("doc_id") % 3 + 1).cast("int"))
    return Views(s, d).table("documents").select("doc_id", dictionary_family(media, role).alias("family"))


def _metadata(s, d):
    """Counts of what each object carries: facets, provenance rows, parts, analyses."""
    v = Views(s, d)
    count = lambda df, name: df.groupBy("digest").agg(F.count("*").alias(name))
    out = v.objects().select("digest")
    for df, name in ((v.facets(), "facets"), (v.provenance(), "sources"), (v.parts(), "parts"), (v.analysis(), "analyses")):
        out = out.join(count(df, name), "digest", "left").fillna(0, [name])
    return out


def _facts(s, d):
    """Triples of provenance and of structure, in one relation."""
    v = Views(s, d)
    a = v.provenance().select(F.col("digest").alias("subject"), F.lit("observed_from").alias("predicate"), F.concat_ws(":", "source_kind", "source_name").alias("object"))
    b = v.parts().select(F.col("digest").alias("subject"), F.lit("contains").alias("predicate"), F.col("part_digest").alias("object"))
    c = v.parts().select(F.col("part_digest").alias("subject"), F.lit("part_of").alias("predicate"), F.col("digest").alias("object"))
    return a.unionByName(b).unionByName(c).distinct()


def _terms(s, d, top: int = 20):
    """The most frequent terms of the whole corpus (a report)."""
    words = Views(s, d).table("documents").select(F.explode(t.tokens("text")).alias("term")).where(F.length("term") >= 3)
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def _compound_text(s, d):
    """The text of each conversation: roles and turns in order."""
    c = Views(s, d).table("conversations")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), t.collapse("text")).alias("line")))), lambda x: x["line"])
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("text_hash"), F.count("*").alias("turns"))


QUERIES = {
    "message_fingerprint": _message,
    "body_line_fingerprint": _docs(lambda: [t.body_fingerprint("text").alias("fingerprint")]),
    "normalize_message_id": lambda s, d: _message(s, d).select("conv_id", "turn", "message_id"),
    "normalize_phone": _phones,
    "normalize_url": lambda s, d: Views(s, d).table("pages").select("page_id", t.url("url").alias("url")),
    "normalize_email": lambda s, d: Views(s, d).table("customer").select("c_custkey", t.email(F.concat(F.when(F.col("c_custkey") % 2 == 0, "mailto:").otherwise("Some One <"), F.lit("Person"), F.col("c_custkey").cast("string"), F.lit("@Mail.Example"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(">"))).alias("email")),
    "alias_slug": lambda s, d: Views(s, d).table("part").select("p_partkey", t.alias_slug("p_name").alias("slug")),
    "name_tokens": _names,
    "stable_uid": lambda s, d: Views(s, d).table("customer").select("c_custkey", t.stable_uid("c_name").alias("uid")),
    "usable_text": _docs(lambda: [t.usable("text").alias("usable")]),
    "collapse_text": _docs(lambda: [F.sha2(t.collapse("text").cast("binary"), 256).alias("collapsed")]),
    "token_counts": _docs(lambda: [F.size(t.tokens("text")).alias("tokens"), F.size(F.array_distinct(t.tokens("text"))).alias("distinct_tokens")]),
    "top_terms": _terms,
    "categories": _categories,
    "dictionary_family": _families,
    "metadata_extract": _metadata,
    "graph_facts": _facts,
    "compound_text": _compound_text,
}

_FLAT = r"trim(regexp_replace({}, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))".format
_MID = "'<msg-' || conv_id || '.' || turn || '@host.example>'"
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SENDER = "['a@github.com', 'News Daily <daily@paper.example>', 'b@linkedin.com', 'c@mail.example', 'gitlab@mg.gitlab.com'][doc_id % 5 + 1]"
_SUBJECT = "['Weekly statement', 'Run failed: pipeline', 'Hello', 'Appointment'][doc_id % 4 + 1]"


def _contains(field: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({field}, '{n}')" for n in needles) + ")"


def _category_sql() -> str:
    hay = {"sender": "s", "domain": "s", "subject": "j", "body": "b", "labels": "l"}
    table = ", ".join(f"CASE WHEN {' AND '.join(_contains(hay[f], n) for f, n in rule.items())} THEN '{name}' END" for name, rule in RULES)
    hub, lab = "(contains(s, 'notifications@github.com') OR contains(x, 'noreply.github.com'))", "contains(s, 'gitlab@mg.gitlab.com')"
    hard = [
        ("call_notice", f"{_contains('s', ['notify@ringcentral.com', 'service@ringcentral.com'])} OR starts_with(j, 'new call')"),
        ("security_admin", f"contains(s, 'google-workspace-alerts-noreply@google.com') OR {_contains('x', ['verify your identity', 'password changed'])} OR ({lab} AND {_contains('j', ['password changed', 'passkey', 'verify your identity'])})"),
        ("financial_statement", "contains(s, 'interactivebrokers.com') OR contains(j, 'statement') OR contains(x, 'trade confirmation')"),
        ("mailing_list", "contains(s, 'tuhs.org') OR l = 'category_forums'"),
        ("newsletter", f"{_contains('s', ['newsletter', 'daily@'])} OR contains(j, 'weekly')"),
        ("social", f"l = 'category_social' OR {_contains('s', ['redditmail.com', 'linkedin.com', 'patreon.com'])}"),
        ("dev_activity", f"{hub} OR {lab}"),
        ("dev_review", f"{hub} AND {_contains('x', ['commented on this pull request', 'review', 'requested'])}"),
        ("dev_ci", f"({hub} AND (contains(x, 'workflow run') OR {_contains('j', ['ci', 'run failed'])})) OR ({lab} AND (contains(x, 'pipeline') OR {_contains('j', ['failed pipeline', 'fixed pipeline'])}))"),
    ]
    hard_sql = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in hard)
    base = f"""CASE WHEN {_contains('s', ['notifications.ui.com', 'unifi os'])} OR contains(x, 'unifi.ui.com') THEN 'camera_alert' END,
 CASE WHEN contains(x, 'smart detection') AND {_contains('x', ['recorded an animal', 'protect/events'])} THEN 'camera_alert' END, CASE WHEN contains(s, 'googlealerts-noreply@google.com') THEN 'news_alert' END,
 CASE WHEN contains(s, 'google-workspace-alerts-noreply@google.com') THEN 'admin_alert' END, CASE WHEN l = 'category_promotions' THEN 'promotion' END, CASE WHEN l = 'category_updates' THEN 'update' END"""
    return f"""WITH m AS (SELECT doc_id, lower({_SENDER}) AS s, lower({_SUBJECT}) AS j, lower(coalesce(text, '')) AS w, CASE doc_id % 6 WHEN 0 THEN 'category_updates' WHEN 1 THEN '1work' ELSE '' END AS l FROM documents),
x AS (SELECT *, j || ' ' || s || '  ' || left(w, 2000) AS x, ' ' || w AS b FROM m),
c AS (SELECT doc_id, list_filter([{base}], lambda y: y IS NOT NULL) AS based, list_filter([{hard_sql}, {table}], lambda y: y IS NOT NULL) AS more FROM x),
a AS (SELECT doc_id, list_distinct(list_concat(CASE WHEN len(based) = 0 THEN ['primary'] ELSE based END, more)) AS f FROM c)
SELECT doc_id, array_to_string(list_sort(CASE WHEN len(list_filter(f, lambda y: y NOT IN ('update', 'primary'))) > 0 THEN list_filter(f, lambda y: y <> 'primary') ELSE f END), ',') AS categories FROM a"""


SQL = {
    "message_fingerprint": f"SELECT conv_id, turn, {_MID} AS message_id, left(sha256({_MID} || chr(10) || {_FLAT('left(text, 40)')} || chr(10) || role || chr(10) || 'all' || chr(10) || {_FLAT('text')}), 32) AS fingerprint FROM conversations",
    "body_line_fingerprint": r"SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: " + _FLAT("x") + r"), lambda x: x <> ''), chr(10))) AS fingerprint FROM documents",
    "normalize_message_id": f"SELECT conv_id, turn, {_MID} AS message_id FROM conversations",
    "normalize_phone": "WITH r AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000 AS VARCHAR), 3, '0') || '555' || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS d, c_custkey % 2 = 0 AS one FROM customer) SELECT c_custkey, CASE WHEN one AND length(d) = 10 THEN d WHEN length(d) + CAST(one AS INTEGER) < 7 THEN '' WHEN one THEN '1' || d ELSE d END AS phone FROM r",
    "normalize_url": r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://(www\.)?|^www\.', ''), '/+$', '') AS url FROM pages",
    "normalize_email": "SELECT c_custkey, 'person' || c_custkey || '@mail.example' AS email FROM customer",
    "alias_slug": r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\-_. ]', '', 'g'), '[\-_. ]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part",
    "name_tokens": r"""SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(['Dr. ', 'Mrs ', ''][c_custkey % 3 + 1] || replace(c_name, '#', ' No ') || CASE WHEN c_custkey % 4 = 0 THEN ', Jr.' ELSE '' END), '[.,]', ' ', 'g'), '[ \t\n\r\x0b\x0c]+'), lambda x: x NOT IN ('', 'dr', 'mrs', 'mr', 'ms', 'jr', 'sr')), '|') AS tokens FROM customer""",
    "stable_uid": "SELECT c_custkey, CASE WHEN h = 0 THEN 1 ELSE h END AS uid FROM (SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: (a * 33 + x) % 2147483648, CAST(0 AS BIGINT)) AS h FROM customer)",
    "usable_text": r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 16 AS usable FROM documents",
    "collapse_text": f"SELECT doc_id, sha256({_FLAT('text')}) AS collapsed FROM documents",
    "token_counts": f"SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS tokens, CAST(len(list_distinct({_TOKENS})) AS INTEGER) AS distinct_tokens FROM documents",
    "top_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM documents) WHERE length(term) >= 3 GROUP BY term ORDER BY n DESC, term LIMIT 20",
    "categories": _category_sql(),
    "dictionary_family": """SELECT doc_id, CASE WHEN m = '' THEN 'opaque_binary' WHEN r = 'headers' THEN 'mail_headers' WHEN r = 'body' AND m = 'text/html' THEN 'mail_body_html' WHEN r = 'body' THEN 'mail_body_plain'
WHEN m = 'application/json' THEN 'structured_json' WHEN m = 'text/html' THEN 'html_css_js' WHEN m = 'text/csv' THEN 'csv_tsv' WHEN m = 'text/markdown' THEN 'document_markup' WHEN m LIKE '%+xml' THEN 'structured_xml' WHEN m LIKE 'text/%' THEN 'logs_line_oriented' ELSE 'opaque_binary' END AS family
FROM (SELECT doc_id, ['text/plain', 'text/html', 'application/json', 'application/x+xml', 'text/csv', 'image/png', '', 'text/markdown'][doc_id % 8 + 1] AS m, ['', 'body', 'headers'][doc_id % 3 + 1] AS r FROM documents)""",
    "metadata_extract": with_views("objects facets provenance parts analysis", "SELECT digest, coalesce(f.n, 0) AS facets, coalesce(p.n, 0) AS sources, coalesce(c.n, 0) AS parts, coalesce(a.n, 0) AS analyses FROM objects LEFT JOIN (SELECT digest, count(*) AS n FROM facets GROUP BY 1) f USING (digest) LEFT JOIN (SELECT digest, count(*) AS n FROM provenance GROUP BY 1) p USING (digest) LEFT JOIN (SELECT digest, count(*) AS n FROM parts GROUP BY 1) c USING (digest) LEFT JOIN (SELECT digest, count(*) AS n FROM analysis GROUP BY 1) a USING (digest)"),
    "graph_facts": with_views("provenance parts", "SELECT digest AS subject, 'observed_from' AS predicate, source_kind || ':' || source_name AS object FROM provenance UNION SELECT digest, 'contains', part_digest FROM parts UNION SELECT part_digest, 'part_of', digest FROM parts"),
    "compound_text": f"SELECT conv_id, sha256(string_agg(role || ': ' || {_FLAT('text')}, chr(10) ORDER BY turn)) AS text_hash, count(*) AS turns FROM conversations GROUP BY conv_id",
}
