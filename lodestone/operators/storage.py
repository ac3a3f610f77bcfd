"""Storage analytics: chunks, reachability, verification, breakdown, source lookup, import decisions, manifest merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.chunks import chunk_table
from lodestone.functions.text import body_fingerprint
from lodestone.operators.common import best_per_key, sorted_set
from lodestone.operators.state import subject_identity
from lodestone.plans.views import Views

HOUR = 3600


def chunks(v: Views) -> DataFrame:
    """digest, ord, start, size, hash of the content-defined chunks of every distinct document."""
    texts = v.table("documents").select(v.digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).cast("binary").alias("content")).dropDuplicates(["digest"])
    return chunk_table(texts)


def chunk_stats(v: Views) -> DataFrame:
    """Chunks and bytes, logical and stored."""
    by_hash = chunks(v).groupBy("hash").agg(F.count("*").alias("refs"), F.max("size").alias("size"))
    return by_hash.agg(F.sum("refs").alias("references"), F.count("*").alias("chunks"), F.sum(F.col("refs") * F.col("size")).alias("logical_bytes"), F.sum("size").alias("stored_bytes"))


def recipes(v: Views) -> DataFrame:
    """recipe, chunk, bytes, updated, has_manifest, annotation: which chunks an order is made of (lines stand for chunks)."""
    o = v.table("orders").select(F.col("o_orderkey").alias("recipe"), F.unix_timestamp("o_orderdate").alias("updated"), (F.col("o_orderstatus") != "F").alias("has_manifest"), (F.col("o_orderkey") % 17 == 0).alias("annotation"))
    line = v.table("lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_partkey").alias("chunk"), F.col("l_quantity").cast("long").alias("bytes"))
    return o.join(line, "recipe")


def collect_garbage(v: Views, grace: int = 15 * 60) -> DataFrame:
    """chunk, state: live if a recipe with a manifest, for an annotation, or younger than the grace time holds it; else dead."""
    r = recipes(v)
    now = v.table("orders").agg(F.max(F.unix_timestamp("o_orderdate")).alias("now"))
    marked = r.crossJoin(F.broadcast(now)).withColumn("live", F.col("has_manifest") | F.col("annotation") | (F.col("updated") >= F.col("now") - grace))  # one row
    return marked.groupBy("chunk").agg(F.when(F.bool_or("live"), "live").otherwise("dead").alias("state"), F.count_if(~F.col("live")).alias("orphan_refs"))


def delete_import(v: Views, source: str) -> DataFrame:
    """digest, outcome of detaching one source: deleted where no provenance is left, else detached."""
    rows = v.table("documents").select(v.digest(F.col("text")).alias("digest"), "source")
    per = rows.groupBy("digest").agg(F.bool_or(F.col("source") == source).alias("hit"), F.bool_or(F.col("source") != source).alias("others"))
    return per.where("hit").select("digest", F.when(F.col("others"), "detached").otherwise("deleted").alias("outcome"))


def repack(v: Views, packs: int = 32) -> DataFrame:
    """pack, bytes, live_bytes, ratio: how much of each pack a repack would keep."""
    state = collect_garbage(v).select("chunk", "state")
    size = recipes(v).groupBy("chunk").agg(F.max("bytes").alias("bytes"))
    joined = size.join(state, "chunk")
    out = joined.groupBy((F.col("chunk") % packs).alias("pack")).agg(F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.when(F.col("state") == "live", F.col("bytes"))), F.lit(0)).alias("live_bytes"))
    return out.withColumn("ratio", F.round(F.col("live_bytes") / F.col("bytes"), 6))


def verify(v: Views, roles: tuple[str, ...] = ("user", "assistant", "system")) -> DataFrame:
    """digest, code: findings over all objects; each check is a plan of its own."""
    o = v.objects()
    parts = v.parts()
    none = o.join(v.facets(), "digest", "left_anti").select("digest", F.lit("manifest_missing_facets").alias("code"))
    dangling = parts.join(v.objects().where("object_id like 'turn:%'").select(F.col("digest").alias("part_digest")), "part_digest", "left_anti").select("digest", F.lit("compound_dangling_part").alias("code"))
    invalid = parts.where(F.col("role").isNull() | ~F.col("role").isin(*roles) | (F.col("ord") < 0)).select("digest", F.lit("compound_invalid_part").alias("code"))
    lost = o.where("not compound").join(v.provenance(), "digest", "left_anti").select("digest", F.lit("source_index_missing").alias("code"))
    odd = v.table("documents").where("n_chars <> char_length(text)").select(v.digest(F.col("text")).alias("digest"), F.lit("blob_digest_mismatch").alias("code"))
    empty = o.where("bytes = 0 and not compound").select("digest", F.lit("blob_read_failed").alias("code"))
    return none.unionByName(dangling).unionByName(invalid).unionByName(lost).unionByName(odd).unionByName(empty).distinct()


def storage_breakdown(v: Views) -> DataFrame:
    """role, parts, objects, bytes, unique_bytes of the parts of compound objects; a part used twice is stored once."""
    o = v.objects().select(F.col("digest").alias("part_digest"), "bytes")
    p = v.parts().join(o, "part_digest")
    once = p.groupBy("role", "part_digest").agg(F.count("*").alias("uses"), F.max("bytes").alias("bytes"))
    return once.groupBy("role").agg(F.sum("uses").alias("parts"), F.count("*").alias("objects"), F.sum(F.col("uses") * F.col("bytes")).alias("bytes"), F.sum("bytes").alias("unique_bytes"))


def source_lookup(v: Views) -> DataFrame:
    """ref, version, digest: the exact version of a page, else the newest one of its address."""
    key = F.regexp_replace("url", r"\?.*$", "")
    stored = v.table("pages").select(key.alias("ref"), (F.col("page_id") % 3).cast("int").alias("version"), v.digest(F.col("html")).alias("digest"), "page_id")
    exact = best_per_key(stored, ["ref", "version"], [F.desc("page_id")]).select("ref", "version", F.col("digest").alias("exact"))
    alias = best_per_key(stored, ["ref"], [F.desc("page_id")]).select("ref", F.col("digest").alias("alias"))
    asked = stored.select("ref").distinct().crossJoin(v.spark.range(3).select(F.col("id").cast("int").alias("version")))
    return asked.join(exact, ["ref", "version"], "left").join(alias, "ref", "left").select("ref", "version", F.coalesce("exact", "alias").alias("digest"))


def import_decisions(v: Views) -> DataFrame:
    """doc_id, decision in the order of arrival: canonical, id_duplicate, variant_minor or variant_major, and promoted. Messages are
    known by their subject, the whole first line; one without letters is a message of its own."""
    first_line = F.lower(F.get(F.split("text", "\n", 2), F.lit(0)))
    message = F.when(first_line.rlike("[a-z]"), subject_identity(F.col("text"))).otherwise(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    d = v.table("documents").select("doc_id", message.alias("message"), body_fingerprint("text").alias("body"), "lang", F.length("text").alias("size"))
    w = W.partitionBy("message").orderBy("doc_id")
    first = d.withColumn("first_body", F.first("body").over(w)).withColumn("first_lang", F.first("lang").over(w)).withColumn("rn", F.row_number().over(w)).withColumn("longest", F.max("size").over(w.rowsBetween(W.unboundedPreceding, -1)))
    first = first.withColumn("seen", F.row_number().over(W.partitionBy("message", "body").orderBy("doc_id")) > 1)
    decision = F.when(F.col("rn") == 1, "canonical").when(F.col("seen"), "id_duplicate").when(F.col("lang").eqNullSafe(F.col("first_lang")), "variant_minor").otherwise("variant_major")
    return first.select("doc_id", decision.alias("decision"), ((F.col("rn") > 1) & ~F.col("seen") & (F.col("size") > F.col("longest"))).alias("promoted"))


def import_report(v: Views) -> DataFrame:
    return import_decisions(v).groupBy("decision").agg(F.count("*").alias("n"), F.count_if("promoted").alias("promoted"))


def merge_manifests(v: Views) -> DataFrame:
    """One manifest a digest from all records of a text: roles and sources united, facet kinds right-wins, the largest version count, the widest scale."""
    d = v.table("documents").select(v.digest(F.col("text")).alias("digest"), "doc_id", "source", "lang", "n_chars")
    return d.groupBy("digest").agg(
        F.array_join(sorted_set("source"), ",").alias("sources"), F.array_join(sorted_set("lang"), ",").alias("roles"), F.max_by("source", "doc_id").alias("last_source"), F.min_by("source", "doc_id").alias("first_source"),
        F.max("n_chars").alias("version_count"), F.max(F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(3)).alias("scale"), F.count("*").alias("records"),
    )


def training_samples(v: Views, most: int = 1024, most_bytes: int = 16 << 10, least: int = 16) -> DataFrame:
    """family, samples, bytes: what a dictionary of each media type could be trained on, within the stated limits."""
    o = v.objects().where("bytes > 0")
    ranked = o.withColumn("rn", F.row_number().over(W.partitionBy("media_type").orderBy("digest"))).where(F.col("rn") <= most)
    out = ranked.groupBy("media_type").agg(F.count("*").alias("samples"), F.sum(F.least("bytes", F.lit(most_bytes))).alias("bytes"))
    return out.where(F.col("samples") >= least)
