"""Contact records from statements: aliases over two hops, claim extraction, validity of bearing nodes, deltas, canonical messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import messages as m
from lodestone.functions.text import collapse, joined_hash, name_tokens
from lodestone.operators.common import best_per_key
from lodestone.plans.views import Views

#: Registered predicates: what each stands for, its kind of evidence and how its value is normalised. Others are left out.
REGISTRY = [("name", "name", "name"), ("alias", "name", "name"), ("email", "email", "set"), ("affiliation", "affiliation", "contextual"), ("title", "title", "contextual"), ("address", "address", "contextual")]


def extract_claims(v: Views) -> DataFrame:
    """contact_id, attr, value, kind: claims of registered predicates only; names give one claim a word."""
    dim = v.spark.createDataFrame(REGISTRY, "predicate string, attr string, evidence string")
    f = v.facts().where("not historical").join(F.broadcast(dim), F.col("kind") == F.col("predicate"))  # the registry
    values = F.when(F.col("evidence") == "name", name_tokens(F.regexp_replace("value", "#", " "))).otherwise(F.array(F.lower(collapse("value"))))
    return f.select("contact_id", "attr", "evidence", F.explode(values).alias("value")).where("value <> ''").distinct()


def nickname_aliases(v: Views) -> DataFrame:
    """owner, alias by two hops: an owner's place, and the place's name."""
    e = v.relationships().where("rel_type = 'located_in'").select(F.col("from_id").alias("owner"), F.col("to_id").alias("node"))
    named = v.table("nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_name").alias("alias"))
    return e.join(named, "node").where("owner like 'supplier:%'").select("owner", "alias")


def import_delta(v: Views, known_modulo: int = 3) -> DataFrame:
    """contact_id, delta, statements: what an import states that the ledger (every known_modulo-th contact, but its addresses) lacks, as
    text lines in order: one delta a contact."""
    number = F.regexp_extract("contact_id", "[0-9]+", 0).cast("bigint")
    line = F.concat_ws(" ", F.concat(F.lit("<"), "contact_id", F.lit(">")), F.concat(F.lit("<urn:fact:"), "kind", F.lit(">")), F.concat(F.lit('"'), "value", F.lit('" .')))
    f = v.facts().select("contact_id", line.alias("line"), joined_hash("contact_id", "kind", "value").alias("h"), ((number % known_modulo == 0) & (F.col("kind") != "email")).alias("known"))
    new = f.join(f.where("known").select("h").distinct(), "h", "left_anti").select("contact_id", "line").distinct()
    return new.groupBy("contact_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("delta"), F.count("*").alias("statements"))


def canonical_messages(v: Views) -> DataFrame:
    """email_id, subject, body_hash, link, reply_to: one canonical row a mail. The last of equal ids counts."""
    c = v.table("conversations").select(F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("email_id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    last = best_per_key(c, ["email_id"], [F.desc("text")])
    return last.select("email_id", F.substring(collapse("text"), 1, 40).alias("subject"), F.sha2(collapse("text").cast("binary"), 256).alias("body_hash"), m.first_url(F.col("text")).alias("link"), F.when(F.col("turn") > 0, F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string"))).alias("reply_to"))


def page_links(v: Views) -> DataFrame:
    """page_id, link, review, actor of every page's source."""
    return v.table("pages").select("page_id", m.first_url(F.col("html")).alias("link"), m.review_link(F.col("html")).alias("review"), m.actor(F.col("html")).alias("actor"))


def accounts(v: Views, suffix: str = "@old.example") -> DataFrame:
    """contact_id, account: instant-messaging accounts that are written as addresses."""
    return v.facts().where("kind = 'email'").select("contact_id", m.account_of(F.col("value"), suffix).alias("account")).where("account <> ''").distinct()


def operations(v: Views) -> DataFrame:
    """request, operation, joined: a request joins the running operation of equal hash, else it starts one."""
    e = v.table("events").select("event_id", joined_hash("user_id", "event_type", F.date_trunc("day", "ts")).alias("request"))
    first = e.groupBy("request").agg(F.min("event_id").alias("operation"), F.count("*").alias("requests"))
    return first.select("request", "operation", (F.col("requests") - 1).alias("joined"))


def message_summaries(v: Views, words: Sequence[str] = ("the",), limit: int = 50) -> DataFrame:
    """Compact rows of mails whose text holds all words, by id."""
    from lodestone.operators.common import web_search

    e = v.emails().where(web_search(F.col("text"), " ".join(words)))
    return e.select("email_id", "thread_id", "mailbox", F.substring(collapse("text"), 1, 240).alias("preview")).orderBy("email_id").limit(limit)
