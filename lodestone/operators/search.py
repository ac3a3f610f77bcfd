"""Faceted and full-text search, structure, relationships, graph, analysis coverage, breakdown and identity reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import body_fingerprint
from lodestone.operators.common import best_per_key, exists, paged, sorted_set, web_search
from lodestone.plans.fixpoint import written
from lodestone.plans.views import Views

ASC = lambda *cs: [F.col(c).asc_nulls_last() for c in cs]


def search(v: Views, text: str | None = None, facets: Sequence[str] = (), media_types: Sequence[str] = (), source_kinds: Sequence[str] = (), source_names: Sequence[str] = (), external_ids: Sequence[str] = (), part_role: str | None = None, analyzer: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Objects that meet every given condition, with their sorted facets and the total.

    The three provenance conditions are independent: each may be met by another row. All conditions are semi-joins, so an
    object shows once however many rows match. Facets are gathered for the page's rows only.
    """
    found = v.objects()
    if text is not None:
        found = exists(found, v.matching(text), "digest")
    if facets:
        found = exists(found, v.facets().where(F.col("kind").isin(*facets)), "digest")
    if media_types:
        found = found.where(F.col("media_type").isin(*media_types))
    for column, wanted in (("source_kind", source_kinds), ("source_name", source_names), ("external_id", external_ids)):
        if wanted:
            found = exists(found, v.provenance().where(F.col(column).isin(*wanted)), "digest")
    if part_role:
        found = exists(found, v.parts().where(F.col("role") == part_role), "digest")
    if analyzer:
        found = exists(found, v.analysis().where(F.col("analyzer") == analyzer), "digest")
    found = written(found.select("digest", "object_id", "media_type"), "hits")  # the page, the total and the facets read it
    page = paged(found, [F.col("object_id"), F.col("digest")], limit, offset)
    kinds = exists(v.facets(), F.broadcast(page.select("digest")), "digest").groupBy("digest").agg(F.array_join(sorted_set("kind"), ",").alias("facets"))  # a page: 1000 rows at most
    return page.join(kinds, "digest", "left").withColumn("score", F.lit(1.0))


def structure(v: Views, role: str | None = None) -> DataFrame:
    """Parts of compound objects in order, each with its facets."""
    parts = v.parts() if role is None else v.parts().where(F.col("role") == role)
    kinds = v.facets().groupBy("digest").agg(F.array_join(sorted_set("kind"), ",").alias("facets"))
    return parts.join(kinds.withColumnRenamed("digest", "part_digest"), "part_digest", "left").select("digest", "role", "ord", "part_digest", F.coalesce("facets", F.lit("")).alias("facets"))


def relationships(v: Views, rel_types: Sequence[str] = (), either: Sequence[str] = (), role: str | None = None, limit: int | None = None) -> DataFrame:
    """Edges that meet all conditions in one row; `either` names ids at any end."""
    found = v.relationships()
    if rel_types:
        found = found.where(F.col("rel_type").isin(*rel_types))
    if either:
        found = found.where(F.col("from_id").isin(*either) | F.col("to_id").isin(*either))
    if role is not None:
        found = found.where(F.col("role") == role)
    return paged(found, ASC("rel_type", "from_id", "to_id", "role"), limit, total=False)


def search_related(v: Views, rel_type: str, role: str) -> DataFrame:
    """Distinct sources of edges whose type and role match in the same row."""
    return v.relationships().where((F.col("rel_type") == rel_type) & (F.col("role") == role)).select("from_id").distinct()


def graph(v: Views, node: str, predicates: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Triples in which the node is subject or object."""
    edges = v.relationships().where((F.col("from_id") == node) | (F.col("to_id") == node))
    if predicates:
        edges = edges.where(F.col("rel_type").isin(*predicates))
    return paged(edges.select(F.col("from_id").alias("subject"), F.col("rel_type").alias("predicate"), F.col("to_id").alias("object")), ASC("subject", "predicate", "object"), limit, total=False)


def hops(v: Views, path: Sequence[str]) -> DataFrame:
    """(start, end, paths): how many paths with the given edge types lead from start to end."""
    edges = v.relationships().select("rel_type", "from_id", "to_id")
    now = edges.where(F.col("rel_type") == path[0]).select(F.col("from_id").alias("start"), F.col("to_id").alias("end")).groupBy("start", "end").agg(F.count("*").alias("paths"))
    for kind in path[1:]:
        step = edges.where(F.col("rel_type") == kind).groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
        now = now.join(step, F.col("end") == F.col("from_id")).groupBy("start", F.col("to_id").alias("end")).agg(F.sum(F.col("paths") * F.col("n")).alias("paths"))
    return now


def analysis_status(v: Views, analyzers: Sequence[str] = (), statuses: Sequence[str] = ()) -> DataFrame:
    found = v.analysis()
    if analyzers:
        found = found.where(F.col("analyzer").isin(*analyzers))
    if statuses:
        found = found.where(F.col("status").isin(*statuses))
    return found.select("digest", "analyzer", "version", "status")


def analysis_required(v: Views, specs: Sequence[tuple[str, str]], media_type: str | None = None) -> DataFrame:
    """Each object with each required analyzer: missing, stale (another version) or the stored status."""
    wanted = v.spark.createDataFrame(list(specs), "analyzer string, required string")
    objects = v.objects() if media_type is None else v.objects().where(F.col("media_type") == media_type)
    asked = objects.select("digest").crossJoin(F.broadcast(wanted))  # the specs are given as arguments
    joined = asked.join(v.analysis(), ["digest", "analyzer"], "left")
    state = F.when(F.col("version").isNull(), "missing").when(F.col("version") != F.col("required"), "stale").otherwise(F.col("status"))
    return joined.select("digest", "analyzer", "required", state.alias("status"))


def breakdown_totals(v: Views) -> DataFrame:
    """Objects, bytes, compound and simple ones, and how many have any analysis."""
    seen = v.analysis().select("digest").distinct().withColumn("analysed", F.lit(1))
    o = v.objects().join(seen, "digest", "left")
    return o.agg(F.count("*").alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if("compound").alias("compound"), F.count_if(~F.col("compound")).alias("simple"), F.count("analysed").alias("analysed"))


def breakdown(v: Views, by: str) -> DataFrame:
    """label, n: objects by facet, media_type, source, analyzer or compound."""
    source = {
        "facet": lambda: v.facets().select("digest", F.col("kind").alias("label")),
        "media_type": lambda: v.objects().select("digest", F.col("media_type").alias("label")),
        "source": lambda: v.provenance().select("digest", F.col("source_name").alias("label")),
        "analyzer": lambda: v.analysis().select("digest", F.col("analyzer").alias("label")),
        "identity": lambda: v.provenance().select("digest", F.col("source_kind").alias("label")),
    }[by]()
    return source.groupBy("label").agg(F.count_distinct("digest").alias("n"))


def projected_at(v: Views, digests_of: str = "documents") -> DataFrame:
    """digest, last: the newest provenance of each object by external id, as a stand-in for its projection time."""
    return v.provenance().where("source_kind = 'corpus'").groupBy("digest").agg(F.max(F.col("external_id").cast("bigint")).alias("last"))


def source_cursors(v: Views) -> DataFrame:
    """Per source: how many records, and the furthest external id (by number)."""
    return v.provenance().where("source_kind = 'corpus'").groupBy("source_name").agg(F.count("*").alias("records"), F.max(F.col("external_id").cast("bigint")).alias("position"))


def identity_missing_live(v: Views, live: str = "src0") -> DataFrame:
    """Identities (body fingerprints) that archives hold and the live source lacks, with their sources and sizes."""
    d = v.table("documents").select("doc_id", "source", body_fingerprint("text").alias("identity"), v.digest(F.col("text")).alias("digest"), "lang")
    archive = d.where(F.col("source") != live).join(d.where(F.col("source") == live).select("identity"), "identity", "left_anti")
    grouped = archive.groupBy("identity").agg(
        F.min("digest").alias("digest"), F.array_join(sorted_set("source"), ",").alias("sources"), sorted_set("source", F.col("lang") != "en").alias("v"),
        F.bool_or(F.col("lang") == "en").alias("english"), F.count_distinct("digest").alias("versions"), F.max(F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)).alias("scale"),
    )
    return grouped.withColumn("variant_sources", F.when(F.size("v") > 0, F.array_join("v", ","))).drop("v")


def fused_search(v: Views, text: str, live_source: str = "src0", limit: int = 50) -> DataFrame:
    """Index hits (score 1) and hits of the live source (score 0.5, or 1.5 for short texts) by digest: the higher score stays, attributes unite."""
    d = v.table("documents").where(web_search(F.col("text"), text))
    index = d.select(v.digest(F.col("text")).alias("digest"), F.lit(1.0).alias("score"), F.lit("index").alias("origin"))
    live = d.where(F.col("source") == live_source).select(v.digest(F.col("text")).alias("digest"), F.when(F.col("n_chars") < 500, 1.5).otherwise(0.5).alias("score"), F.lit("live").alias("origin"))
    fused = index.unionByName(live).groupBy("digest").agg(F.max("score").alias("score"), F.array_join(sorted_set("origin"), "+").alias("origins"))
    return fused.orderBy(F.desc("score"), "digest").limit(limit)


def snippets(v: Views, needle: str) -> DataFrame:
    from lodestone.functions.text import snippet

    return v.table("documents").select("doc_id", snippet("text", needle).alias("snippet")).where("snippet is not null")


def latest_analysis(v: Views) -> DataFrame:
    """The newest analysis of each object over all analyzers."""
    return best_per_key(v.analysis(), ["digest"], [F.desc("generated"), F.asc("analyzer")]).select("digest", "analyzer", "generated")
