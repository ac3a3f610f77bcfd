"""Contact facts, bindings, aliases, rollups and lookups; RDF rows of contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import alias_slug, joined_hash, sha256_hex
from lodestone.operators.common import best_per_key, paged, web_search
from lodestone.plans.projection import byte_prefix
from lodestone.plans.views import Views

#: The fact kinds that a contact's neighbourhood shows unless others are asked for.
NEIGHBOURS = ("affiliation", "alias", "identifier", "relationship", "title", "url")


def current(facts: DataFrame) -> DataFrame:
    return facts.where("not historical and valid_until = ''")


def as_of(facts: DataFrame, at: str) -> DataFrame:
    """Facts that hold at a time; '' is open, both ends belong to the range, strings compare as they are."""
    return facts.where(((F.col("valid_from") == "") | (F.col("valid_from") <= at)) & ((F.col("valid_until") == "") | (F.col("valid_until") >= at)))


def overlapping(facts: DataFrame, since: str = "", until: str = "") -> DataFrame:
    if until:
        facts = facts.where((F.col("valid_from") == "") | (F.col("valid_from") <= until))
    if since:
        facts = facts.where((F.col("valid_until") == "") | (F.col("valid_until") >= since))
    return facts


def statements(v: Views) -> DataFrame:
    """subject, predicate, object, statement_hash of every fact."""
    f = v.facts()
    pred = F.concat(F.lit("urn:fact:"), "kind")
    return f.select(F.col("contact_id").alias("subject"), pred.alias("predicate"), F.col("value").alias("object"), joined_hash("contact_id", pred, "value").alias("statement_hash")).distinct()


def terms(v: Views) -> DataFrame:
    """term_key, term_kind, value of every distinct term."""
    s = statements(v)
    iri = s.select(F.explode(F.array("subject", "predicate")).alias("value")).withColumn("term_kind", F.lit("iri"))
    literal = s.select(F.col("object").alias("value")).withColumn("term_kind", F.lit("literal"))
    return iri.unionByName(literal).distinct().select(joined_hash("term_kind", "value").alias("term_key"), "term_kind", "value")


def bindings(v: Views) -> DataFrame:
    """contact_id, token, token_hash, historical of every email fact."""
    return v.facts().where("kind = 'email'").groupBy("contact_id", F.lower("value").alias("token")).agg(F.bool_and("historical").alias("historical")).select("contact_id", "token", sha256_hex("token").alias("token_hash"), "historical")


def identity_details(v: Views, tokens: Sequence[str]) -> DataFrame:
    return bindings(v).where(F.col("token").isin(*[t.lower() for t in tokens]))


def alias_claims(v: Views) -> DataFrame:
    """slug, contact_id: each slug goes to one owner, the smallest contact that claims it."""
    claims = v.facts().where(F.col("kind").isin("name", "alias")).select("contact_id", alias_slug(F.regexp_replace("value", "[0-9]{4,}", "")).alias("slug")).where("slug <> ''")
    return claims.groupBy("slug").agg(F.min("contact_id").alias("contact_id"), F.count("*").alias("claims"))


def resolve(v: Views, refs: Sequence[str]) -> DataFrame:
    """ref, contact_id: an exact id, else the owner of the slug, else the reference itself."""
    asked = v.spark.createDataFrame([(r,) for r in refs], "ref string")
    ids = v.facts().select(F.col("contact_id").alias("exact")).distinct()
    slugs = alias_claims(v).select("slug", F.col("contact_id").alias("owner"))
    found = asked.join(ids, F.col("ref") == F.col("exact"), "left").join(slugs, alias_slug("ref") == F.col("slug"), "left")
    return found.select("ref", F.coalesce("exact", "owner", "ref").alias("contact_id"))


def rollups(v: Views) -> DataFrame:
    """One row a contact: name, primary email, counts, importance, first and last message, search text."""
    f = v.facts()
    live_email = (F.col("kind") == "email") & ~F.col("historical")
    number = F.when((F.col("kind") == "importance") & F.col("value").rlike("^[0-9]+$"), F.expr("try_cast(value as int)"))
    base = f.groupBy("contact_id").agg(
        F.coalesce(F.min(F.when(F.col("kind") == "name", F.col("value"))), F.min(F.when(F.col("kind") == "alias", F.col("value"))), F.first("contact_id")).alias("display_name"),
        F.coalesce(F.min(F.when(live_email, F.col("value"))), F.min(F.when(F.col("kind") == "email", F.col("value"))), F.lit("")).alias("primary_email"),
        F.count("*").alias("fact_count"), F.coalesce(F.max(number), F.lit(0)).alias("importance"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "value"))), lambda x: x["value"]), " ").alias("search_text"),
    )
    seen = bindings(v).select("contact_id", "token", "token_hash").distinct().join(v.participants().select("token", "token_hash", "message", "message_time"), ["token_hash", "token"])
    seen = seen.groupBy("contact_id").agg(F.min("message_time").alias("first_message"), F.max("message_time").alias("last_message"), F.count_distinct("message").alias("messages"), F.count("*").alias("observations"))
    return base.join(seen, "contact_id", "left").select("contact_id", "display_name", "primary_email", "fact_count", "importance", "search_text", "first_message", "last_message", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("observations", F.lit(0)).alias("observations"))


def aggregate(v: Views, contact_ids: Sequence[str]) -> DataFrame:
    """Rollup and ordered facts of the asked contacts; an unknown one has an empty aggregate."""
    asked = v.spark.createDataFrame([(c,) for c in contact_ids], "contact_id string")
    f = v.facts().where(F.col("contact_id").isin(*contact_ids)).groupBy("contact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "value"))), lambda x: F.concat(x["kind"], F.lit("="), x["value"])), ";").alias("facts"))
    r = rollups(v).where(F.col("contact_id").isin(*contact_ids)).select("contact_id", "display_name", "messages")
    return asked.join(r, "contact_id", "left").join(f, "contact_id", "left").select("contact_id", F.coalesce("display_name", F.lit("")).alias("display_name"), F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("facts", F.lit("")).alias("facts"))


def search(v: Views, text: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    base = v.facts().groupBy("contact_id").agg(F.coalesce(F.min(F.when(F.col("kind") == "name", F.col("value"))), F.min(F.when(F.col("kind") == "alias", F.col("value")))).alias("display_name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "value"))), lambda x: x["value"]), " ").alias("search_text"))
    return paged(base.where(web_search(F.col("search_text"), text)).select("contact_id", "display_name"), [F.col("display_name"), F.col("contact_id")], limit, offset)


def neighbourhood(v: Views, kinds: Sequence[str] = NEIGHBOURS) -> DataFrame:
    return v.facts().where(F.col("kind").isin(*kinds)).select("contact_id", "kind", "value")


def analysis_inputs(v: Views, most_facts: int = 200, most_bytes: int = 12_000) -> DataFrame:
    """contact_id, text: the first facts of each contact as lines, cut at a byte limit between characters."""
    ranked = v.facts().withColumn("rn", F.row_number().over(W.partitionBy("contact_id").orderBy("kind", "value", "historical"))).where(F.col("rn") <= most_facts)
    lines = ranked.groupBy("contact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "kind", "value"))), lambda x: F.concat(x["kind"], F.lit(": "), x["value"])), "\n").alias("text"))
    return lines.select("contact_id", byte_prefix(F.col("text"), most_bytes).alias("text"))


def messages(v: Views, contact_ids: Sequence[str], roles: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Messages of contacts by their identities, newest first."""
    tokens = bindings(v).where(F.col("contact_id").isin(*contact_ids)).select("token", "token_hash").distinct()
    found = v.participants() if not roles else v.participants().where(F.col("role").isin(*roles))
    found = found.join(tokens, ["token_hash", "token"])
    order = [F.col("message_time").desc_nulls_last(), F.col("message"), F.col("role"), F.col("ordinal"), F.col("token")]
    return paged(found.select("message", "role", "ordinal", "token", "message_time"), order, limit)


def analysis_status(v: Views, statuses: Sequence[str] = (), contact_ids: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """contact_id, status, generated: missing, stale (facts have changed since) or complete, the newest first, those never analysed last."""
    number = F.regexp_extract("contact_id", "[0-9]+", 0).cast("bigint")
    state = v.facts().groupBy("contact_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "value"))), ";"), 256).alias("input_hash"))
    stored = state.where(number % 3 != 0).select("contact_id", F.when(number % 3 == 1, F.col("input_hash")).otherwise("old").alias("stored"), number.alias("generated"))
    status = F.when(F.col("stored").isNull(), "missing").when(F.col("stored") != F.col("input_hash"), "stale").otherwise("complete")
    found = state.join(stored, "contact_id", "left").select("contact_id", status.alias("status"), "generated")
    if statuses:
        found = found.where(F.col("status").isin(*statuses))
    if contact_ids:
        found = found.where(F.col("contact_id").isin(*contact_ids))
    return paged(found, [F.col("generated").desc_nulls_last(), F.col("contact_id")], limit)


def latest_fact(v: Views) -> DataFrame:
    """Of facts with equal contact, kind and value the one with the strongest validity: a set end first, then a set start."""
    order = [F.desc(F.col("valid_until") != ""), F.desc(F.col("valid_from") != ""), F.asc("historical")]
    return best_per_key(v.facts(), ["contact_id", "kind", "value"], order).select("contact_id", "kind", "value", "historical", "valid_until")
