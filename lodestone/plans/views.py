"""The relations of the data model, as lazy plans over the input tables.

A text is an object named by the SHA-256 of its content, so equal texts are one object with several provenance rows. A
conversation is a compound object whose parts are its turns. Only the columns a query asks for reach the Parquet scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a table of short rows that one task unfolds.
SPREAD_ROWS = 50_000


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str, rows: int = SPREAD_ROWS) -> DataFrame:
        """A table of short rows dealt by its key to parts of about `rows` rows. Each row becomes several longer ones; by the size of its
        files alone a few tasks would make them all."""
        df = self.table(name)
        parts = -(-df.count() // rows)
        return df if parts <= 1 else df.repartition(parts, key)

    @staticmethod
    def digest(column) -> F.Column:
        return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)

    @staticmethod
    def conversation_digest(conv_id) -> F.Column:
        return F.sha2(F.concat(F.lit("compound:conv:"), conv_id.cast("string")).cast("binary"), 256)

    def records(self) -> DataFrame:
        """One row for each input row: digest, object_id, media_type, bytes, compound."""
        text = lambda t, c, name, media: self.table(t).select(self.digest(F.col(c)).alias("digest"), name.alias("object_id"), F.lit(media).alias("media_type"), F.octet_length(F.coalesce(F.col(c), F.lit(""))).cast("long").alias("bytes"), F.lit(False).alias("compound"))
        turn = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
        whole = self.table("conversations").select("conv_id").distinct().select(self.conversation_digest(F.col("conv_id")).alias("digest"), F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("object_id"), F.lit("multipart/mixed").alias("media_type"), F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("compound"))
        return reduce(DataFrame.unionByName, [
            text("documents", "text", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), "text/plain"),
            text("pages", "html", F.concat(F.lit("page:"), F.col("page_id").cast("string")), "text/html"),
            text("conversations", "text", turn, "message/rfc822"), whole,
        ])

    def texts(self) -> DataFrame:
        """digest, text of what full-text search covers."""
        return reduce(DataFrame.unionByName, [self.table(t).select(self.digest(F.col("text")).alias("digest"), "text") for t in ("documents", "conversations")])

    def matching(self, query: str) -> DataFrame:
        """digest of the texts that a web-style query matches, found in the texts themselves."""
        from lodestone.operators.common import web_search

        return self.texts().where(web_search(F.col("text"), query)).select("digest")

    def objects(self) -> DataFrame:
        """digest, object_id, media_type, bytes, compound: one row an object."""
        return self.records().groupBy("digest").agg(F.min("object_id").alias("object_id"), F.min("media_type").alias("media_type"), F.max("bytes").alias("bytes"), F.bool_or("compound").alias("compound"))

    def provenance(self) -> DataFrame:
        """digest, source_kind, source_name, external_id."""
        docs = self.table("documents").select(self.digest(F.col("text")).alias("digest"), F.lit("corpus").alias("source_kind"), F.col("source").alias("source_name"), F.col("doc_id").cast("string").alias("external_id"))
        pages = self.table("pages").select(self.digest(F.col("html")).alias("digest"), F.lit("web").alias("source_kind"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("source_name"), F.col("url").alias("external_id"))
        turns = self.table("conversations").select(self.digest(F.col("text")).alias("digest"), F.lit("chat").alias("source_kind"), F.col("role").alias("source_name"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("external_id"))
        return docs.unionByName(pages).unionByName(turns)

    def facets(self) -> DataFrame:
        """digest, kind; distinct."""
        d = self.table("documents").select(self.digest(F.col("text")).alias("digest"), F.explode(F.array(F.lit("document"), F.concat(F.lit("lang:"), "lang"))).alias("kind"))
        p = self.table("pages").select(self.digest(F.col("html")).alias("digest"), F.lit("web_page").alias("kind"))
        c = self.table("conversations").select(self.digest(F.col("text")).alias("digest"), F.lit("mail_message").alias("kind"))
        t = self.table("conversations").select(self.conversation_digest(F.col("conv_id")).alias("digest"), F.lit("thread").alias("kind"))
        return reduce(DataFrame.unionByName, [d, p, c, t]).where("kind is not null").distinct()

    def parts(self) -> DataFrame:
        """digest, part_digest, role, ord: the parts of compound objects."""
        return self.table("conversations").select(self.conversation_digest(F.col("conv_id")).alias("digest"), self.digest(F.col("text")).alias("part_digest"), "role", F.col("turn").alias("ord"))

    def analysis(self) -> DataFrame:
        """digest, analyzer, version, status, generated: latest of each analyzer."""
        rows = self.table("labels").join(self.table("documents").select("doc_id", self.digest(F.col("text")).alias("digest")), "doc_id").select("digest", "doc_id", "quality", "toxic")
        one = rows.select("digest", F.lit("quality").alias("analyzer"), F.lit("1").alias("version"), F.when(F.col("quality") == 1, "complete").otherwise("failed").alias("status"), F.col("doc_id").alias("generated"))
        two = rows.select("digest", F.lit("toxicity").alias("analyzer"), F.when(F.col("doc_id") % 3 == 0, "2").otherwise("1").alias("version"), F.when(F.col("toxic").isNull(), "invalid").otherwise("complete").alias("status"), F.col("doc_id").alias("generated"))
        both = one.unionByName(two)
        return both.groupBy("digest", "analyzer").agg(F.max(F.struct("generated", "version", "status")).alias("x")).select("digest", "analyzer", "x.version", "x.status", "x.generated")

    def relationships(self) -> DataFrame:
        """rel_type, from_id, to_id, role."""
        name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
        rel = lambda df, kind, a, b, role: df.select(F.lit(kind).alias("rel_type"), a.alias("from_id"), b.alias("to_id"), role.alias("role"))
        return reduce(DataFrame.unionByName, [
            rel(self.table("customer"), "located_in", name("customer", "c_custkey"), name("nation", "c_nationkey"), F.col("c_mktsegment")),
            rel(self.table("supplier"), "located_in", name("supplier", "s_suppkey"), name("nation", "s_nationkey"), F.lit("")),
            rel(self.table("nation"), "part_of", name("nation", "n_nationkey"), name("region", "n_regionkey"), F.lit("")),
            rel(self.table("orders"), "placed_by", name("order", "o_orderkey"), name("customer", "o_custkey"), F.col("o_orderpriority")),
            rel(self.table("lineitem"), "contains", name("order", "l_orderkey"), name("part", "l_partkey"), F.col("l_returnflag")),
        ])

    def facts(self) -> DataFrame:
        """contact_id, kind, value, historical, valid_from, valid_until: contacts unpivoted to facts; '' is an open bound."""
        c = self.spread("customer", "c_custkey").join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: 25 rows by the schema
        email = lambda key, at: F.concat(F.lower(F.regexp_replace(F.col(key), "[^A-Za-z0-9]", "")), F.lit(at))
        year = lambda k: (F.lit(1990) + F.col(k) % 20).cast("string")
        row = lambda kind, value, hist=F.lit(False), since=F.lit(""), until=F.lit(""): F.struct(F.lit(kind).alias("kind"), value.alias("value"), hist.alias("historical"), since.alias("valid_from"), until.alias("valid_until"))
        customers = c.select(F.concat(F.lit("contact:c"), F.col("c_custkey").cast("string")).alias("contact_id"), F.explode(F.array(
            row("name", F.col("c_name")), row("email", email("c_name", "@mail.example")), row("affiliation", F.col("c_mktsegment"), since=year("c_custkey")),
            row("address", F.col("n_name")), row("importance", F.floor(F.abs("c_acctbal") / 1000).cast("string")),
            row("email", email("c_name", "@old.example"), F.col("c_custkey") % 3 == 0, until=F.when(F.col("c_custkey") % 3 == 0, year("c_nationkey")).otherwise(F.lit(""))),
        )).alias("f")).select("contact_id", "f.*")
        suppliers = self.spread("supplier", "s_suppkey").select(F.concat(F.lit("contact:s"), F.col("s_suppkey").cast("string")).alias("contact_id"), F.explode(F.array(
            row("alias", F.col("s_name")), row("email", email("s_name", "@trade.example")), row("title", F.lit("Supplier")), row("importance", F.lit("n/a")),
        )).alias("f")).select("contact_id", "f.*")
        return customers.unionByName(suppliers)

    def participants(self) -> DataFrame:
        """message, role, ordinal, token, token_hash, message_time: who takes part in which message."""
        o = self.table("orders").join(self.table("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        sender = o.select(F.col("o_orderkey").alias("message"), F.lit("from").alias("role"), F.lit(0).alias("ordinal"), F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@mail.example")).alias("token"), F.col("o_orderdate").alias("message_time"))
        line = self.table("lineitem").join(self.table("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(self.table("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        to = line.select(F.col("l_orderkey").alias("message"), F.when(F.col("l_linenumber") == 1, "to").otherwise("cc").alias("role"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")), F.lit("@trade.example")).alias("token"), F.col("o_orderdate").alias("message_time"))
        return sender.unionByName(to).withColumn("token_hash", F.sha2("token", 256))

    def emails(self) -> DataFrame:
        """digest, thread_id, received_at, mailbox, keywords: the mail state of each turn."""
        ev = self.table("conversations")
        received = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 500 as int), cast(turn as int), 0)")
        box = F.when(F.col("role") == "system", "trash").when(F.col("role") == "assistant", "sent").otherwise("inbox")
        words = F.array_compact(F.array(F.when(F.col("turn") % 2 == 0, "$seen"), F.when(F.col("conv_id") % 5 == 0, "$flagged")))
        return ev.select(F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("email_id"), F.col("conv_id").alias("thread_id"), F.when(F.col("turn") < 7, received).alias("received_at"), box.alias("mailbox"), words.alias("keywords"), "text")


#: The same relations in DuckDB SQL, for the oracles.
SQL = {
    "records": """records AS (
  SELECT sha256(coalesce(text, '')) AS digest, 'doc:' || doc_id AS object_id, 'text/plain' AS media_type, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, false AS compound FROM documents
  UNION ALL SELECT sha256(coalesce(html, '')), 'page:' || page_id, 'text/html', strlen(coalesce(html, '')), false FROM pages
  UNION ALL SELECT sha256(coalesce(text, '')), 'turn:' || conv_id || ':' || turn, 'message/rfc822', strlen(coalesce(text, '')), false FROM conversations
  UNION ALL SELECT DISTINCT sha256('compound:conv:' || conv_id), 'conv:' || conv_id, 'multipart/mixed', 0, true FROM conversations)""",
    "objects": """objects AS (SELECT digest, min(object_id) AS object_id, min(media_type) AS media_type, max(bytes) AS bytes, bool_or(compound) AS compound FROM records GROUP BY digest)""",
    "provenance": """provenance AS (
  SELECT sha256(coalesce(text, '')) AS digest, 'corpus' AS source_kind, source AS source_name, CAST(doc_id AS VARCHAR) AS external_id FROM documents
  UNION ALL SELECT sha256(coalesce(html, '')), 'web', regexp_extract(url, '^[a-z]+://([^/]+)', 1), url FROM pages
  UNION ALL SELECT sha256(coalesce(text, '')), 'chat', role, conv_id || ':' || turn FROM conversations)""",
    "facets": """facets AS (SELECT DISTINCT * FROM (
  SELECT sha256(coalesce(text, '')) AS digest, 'document' AS kind FROM documents
  UNION ALL SELECT sha256(coalesce(text, '')), 'lang:' || lang FROM documents
  UNION ALL SELECT sha256(coalesce(html, '')), 'web_page' FROM pages
  UNION ALL SELECT sha256(coalesce(text, '')), 'mail_message' FROM conversations
  UNION ALL SELECT sha256('compound:conv:' || conv_id), 'thread' FROM conversations) WHERE kind IS NOT NULL)""",
    "parts": """parts AS (SELECT sha256('compound:conv:' || conv_id) AS digest, sha256(coalesce(text, '')) AS part_digest, role, turn AS ord FROM conversations)""",
    "analysis": """labelled AS (SELECT sha256(coalesce(text, '')) AS digest, doc_id, quality, toxic FROM labels JOIN documents USING (doc_id)),
analysis AS (SELECT digest, analyzer, version, status, generated FROM (
  SELECT *, row_number() OVER (PARTITION BY digest, analyzer ORDER BY generated DESC, version DESC, status DESC) AS rn FROM (
    SELECT digest, 'quality' AS analyzer, '1' AS version, CASE WHEN quality = 1 THEN 'complete' ELSE 'failed' END AS status, doc_id AS generated FROM labelled
    UNION ALL SELECT digest, 'toxicity', CASE WHEN doc_id % 3 = 0 THEN '2' ELSE '1' END, CASE WHEN toxic IS NULL THEN 'invalid' ELSE 'complete' END, doc_id FROM labelled)) WHERE rn = 1)""",
    "relationships": """relationships AS (
  SELECT 'located_in' AS rel_type, 'customer:' || c_custkey AS from_id, 'nation:' || c_nationkey AS to_id, c_mktsegment AS role FROM customer
  UNION ALL SELECT 'located_in', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, '' FROM supplier
  UNION ALL SELECT 'part_of', 'nation:' || n_nationkey, 'region:' || n_regionkey, '' FROM nation
  UNION ALL SELECT 'placed_by', 'order:' || o_orderkey, 'customer:' || o_custkey, o_orderpriority FROM orders
  UNION ALL SELECT 'contains', 'order:' || l_orderkey, 'part:' || l_partkey, l_returnflag FROM lineitem)""",
    "facts": """cust AS (SELECT *, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS handle FROM customer JOIN nation ON c_nationkey = n_nationkey),
facts AS (
  SELECT 'contact:c' || c_custkey AS contact_id, 'name' AS kind, c_name AS value, false AS historical, '' AS valid_from, '' AS valid_until FROM cust
  UNION ALL SELECT 'contact:c' || c_custkey, 'email', handle || '@mail.example', false, '', '' FROM cust
  UNION ALL SELECT 'contact:c' || c_custkey, 'affiliation', c_mktsegment, false, CAST(1990 + c_custkey % 20 AS VARCHAR), '' FROM cust
  UNION ALL SELECT 'contact:c' || c_custkey, 'address', n_name, false, '', '' FROM cust
  UNION ALL SELECT 'contact:c' || c_custkey, 'importance', CAST(CAST(floor(abs(c_acctbal) / 1000) AS BIGINT) AS VARCHAR), false, '', '' FROM cust
  UNION ALL SELECT 'contact:c' || c_custkey, 'email', handle || '@old.example', c_custkey % 3 = 0, '', CASE WHEN c_custkey % 3 = 0 THEN CAST(1990 + c_nationkey % 20 AS VARCHAR) ELSE '' END FROM cust
  UNION ALL SELECT 'contact:s' || s_suppkey, 'alias', s_name, false, '', '' FROM supplier
  UNION ALL SELECT 'contact:s' || s_suppkey, 'email', lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '@trade.example', false, '', '' FROM supplier
  UNION ALL SELECT 'contact:s' || s_suppkey, 'title', 'Supplier', false, '', '' FROM supplier
  UNION ALL SELECT 'contact:s' || s_suppkey, 'importance', 'n/a', false, '', '' FROM supplier)""",
    "participants": """participants AS (SELECT *, sha256(token) AS token_hash FROM (
  SELECT o_orderkey AS message, 'from' AS role, 0 AS ordinal, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@mail.example' AS token, o_orderdate AS message_time FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'to' ELSE 'cc' END, l_linenumber, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '@trade.example', o_orderdate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey))""",
    "emails": """emails AS (SELECT 'turn:' || conv_id || ':' || turn AS email_id, conv_id AS thread_id,
  CASE WHEN turn < 7 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id % 500 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) END AS received_at,
  CASE role WHEN 'system' THEN 'trash' WHEN 'assistant' THEN 'sent' ELSE 'inbox' END AS mailbox,
  list_filter([CASE WHEN turn % 2 = 0 THEN '$seen' END, CASE WHEN conv_id % 5 = 0 THEN '$flagged' END], lambda x: x IS NOT NULL) AS keywords, text FROM conversations)""",
}
NEEDS = {"objects": ["records"]}


def with_views(names: str, sql: str) -> str:
    """sql preceded by the named relations and what they need."""
    order: list[str] = []
    for name in names.split():
        order += [n for n in [*NEEDS.get(name, []), name] if n not in order]
    ctes = ",\n".join(SQL[n] for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
