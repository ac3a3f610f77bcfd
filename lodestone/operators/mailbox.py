"""Mailboxes, mail states, mail queries, threads and blob lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import collapse
from lodestone.operators.common import paged, sorted_set, web_search
from lodestone.plans.fixpoint import reachable
from lodestone.plans.views import Views

#: The system mailboxes in their order, and which label decides where a new mail lies.
SYSTEM_MAILBOXES = ["inbox", "archive", "sent", "drafts", "trash", "spam", "all", "starred", "unread"]
LABEL_ORDER = [("TRASH", "trash"), ("SPAM", "spam"), ("SENT", "sent"), ("DRAFT", "drafts"), ("INBOX", "inbox")]


def mailboxes(v: Views, destroyed: Sequence[str] = ()) -> DataFrame:
    """id, name, sort_order of the live mailboxes."""
    rows = [(b, b.capitalize(), i) for i, b in enumerate(SYSTEM_MAILBOXES) if b not in destroyed]
    return v.spark.createDataFrame(rows, "id string, name string, sort_order int").orderBy("sort_order", "name", "id")


def mailbox_counts(v: Views, ids: Sequence[str]) -> DataFrame:
    """id, emails, unread: zero where a mailbox is empty or unknown."""
    asked = v.spark.createDataFrame([(i,) for i in ids], "id string")
    seen = F.array_contains("keywords", "$seen")
    counts = v.emails().groupBy(F.col("mailbox").alias("id")).agg(F.count("*").alias("emails"), F.count_if(~seen).alias("unread"))
    return asked.join(counts, "id", "left").select("id", F.coalesce("emails", F.lit(0)).alias("emails"), F.coalesce("unread", F.lit(0)).alias("unread"))


def email_states(v: Views, destroyed: Sequence[str] = ()) -> DataFrame:
    """email_id, thread_id, received_at, mailboxes, keywords: each side gathered before the join, so no side multiplies another."""
    e = v.emails()
    boxes = e.select("email_id", F.explode(F.array("mailbox", F.lit("all"))).alias("box")).where(~F.col("box").isin(*destroyed) if destroyed else F.lit(True)).groupBy("email_id").agg(F.array_join(sorted_set("box"), ",").alias("mailboxes"))
    words = e.select("email_id", F.explode("keywords").alias("k")).groupBy("email_id").agg(F.array_join(sorted_set("k"), ",").alias("keywords"))
    return e.select("email_id", "thread_id", "received_at").join(boxes, "email_id", "left").join(words, "email_id", "left").select("email_id", "thread_id", "received_at", F.coalesce("mailboxes", F.lit("")).alias("mailboxes"), F.coalesce("keywords", F.lit("")).alias("keywords"))


def email_query(v: Views, text: str | None = None, mailbox: str | None = None, has: str | None = None, lacks: str | None = None, after: str | None = None, before: str | None = None, limit: int | None = None) -> DataFrame:
    """Mails newest first; times are half open, mails without a time last."""
    e = v.emails()
    if text:
        e = e.where(web_search(F.col("text"), text))
    if mailbox:
        e = e.where(F.col("mailbox") == mailbox)
    if has:
        e = e.where(F.array_contains("keywords", has))
    if lacks:
        e = e.where(~F.array_contains("keywords", lacks))
    if after:
        e = e.where(F.col("received_at") >= F.lit(after).cast("timestamp_ntz"))
    if before:
        e = e.where(F.col("received_at") < F.lit(before).cast("timestamp_ntz"))
    return paged(e.select("email_id", "thread_id", "received_at"), [F.col("received_at").desc_nulls_last(), F.col("email_id")], limit)


def threads(v: Views) -> DataFrame:
    """thread_id, emails in the order received, those without a time last."""
    one = F.struct(F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("t"), "email_id")
    return v.emails().groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["email_id"]), ",").alias("emails"), F.count("*").alias("n"))


def containment(v: Views) -> DataFrame:
    """source, target: part to whole; turns lie in conversations, conversations in binders, and one binder in a conversation (a cycle)."""
    turn = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    conv = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))
    binder = F.concat(F.lit("binder:"), (F.col("conv_id") % 7).cast("string"))
    c = v.table("conversations")
    inner = c.select(turn.alias("source"), conv.alias("target"))
    outer = c.select(conv.alias("source"), binder.alias("target")).distinct()
    loop = v.spark.createDataFrame([("binder:3", "conv:3"), ("binder:3", "binder:4")], "source string, target string")
    return inner.unionByName(outer).unionByName(loop)


def blob_lookup(v: Views) -> DataFrame:
    """For every turn: all wholes that hold it, however deep."""
    seeds = v.table("conversations").select(F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("seed"))
    return reachable(seeds, containment(v), include_seeds=False)


def default_mailboxes(v: Views) -> DataFrame:
    """doc_id, mailboxes, keywords: where a mail with the document's labels lies before anybody moves it."""
    d = v.table("documents").select("doc_id", F.array_compact(F.array(
        F.when(F.col("doc_id") % 11 == 0, "TRASH"), F.when(F.col("doc_id") % 7 == 0, "SPAM"), F.when(F.col("doc_id") % 5 == 0, "SENT"), F.when(F.col("doc_id") % 2 == 0, "INBOX"), F.when(F.col("doc_id") % 3 == 0, "UNREAD"), F.when(F.col("doc_id") % 13 == 0, "STARRED"),
    )).alias("labels"))
    box = None
    for label, name in LABEL_ORDER:
        hit = F.array_contains("labels", label)
        box = F.when(hit, name) if box is None else box.when(hit, name)
    words = F.array_compact(F.array(F.when(F.array_contains("labels", "STARRED"), "$flagged"), F.when(~F.array_contains("labels", "UNREAD"), "$seen")))
    return d.select("doc_id", F.array_join(F.array(F.lit("all"), box.otherwise("archive")), ",").alias("mailboxes"), F.array_join(words, ",").alias("keywords"))


def catalog_problems(v: Views, catalog: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(id, problem) of a proposed catalog of (id, name, parent): system ids, repeated ids, equal names under a parent, unknown or own parents."""
    df = v.spark.createDataFrame(list(catalog), "id string, name string, parent string").withColumn("name", collapse("name"))
    system = df.where(F.col("id").isin(*SYSTEM_MAILBOXES)).select("id", F.lit("system id").alias("problem"))
    twice = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    named = df.groupBy(F.lower("name").alias("k"), "parent").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n > 1").select("id", F.lit("repeated name").alias("problem"))
    own = df.where("id = parent").select("id", F.lit("own parent").alias("problem"))
    lost = df.where("parent <> ''").join(df.select(F.col("id").alias("p")).unionByName(v.spark.createDataFrame([(b,) for b in SYSTEM_MAILBOXES], "p string")).distinct(), F.col("parent") == F.col("p"), "left_anti").select("id", F.lit("unknown parent").alias("problem"))
    return system.unionByName(twice).unionByName(named).unionByName(own).unionByName(lost)
