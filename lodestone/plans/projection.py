"""Projection of nested manifests into flat tables: each table is one select or explode over the manifests.

A manifest is one row: digest, object_id, media_type, roles, created, updated, and the child lists facets, titles, provenance,
relationships, parts, graph_facts, keywords, embeddings, annotations, with overlays as a map and findings as strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.fixpoint import written
from lodestone.plans.views import Views

SCHEMA = """digest string, object_id string, media_type string, roles array<string>, created timestamp_ntz, updated timestamp_ntz,
facets array<struct<kind:string,name:string,version:string,metadata:map<string,string>>>, titles array<struct<value:string,source:string,confidence:double>>,
provenance array<struct<source_kind:string,source_name:string,external_id:string,version:string>>, relationships array<struct<type:string,from:string,to:string,role:string,ord:int>>,
parts array<struct<digest:string,role:string,ord:int>>, graph_facts array<struct<subject:string,predicate:string,object:string>>, keywords array<string>,
embeddings array<struct<model:string,id:string,vector:array<float>>>, annotations array<struct<kind:string,analyzer:string,version:string,generated:timestamp_ntz,data:map<string,string>>>,
overlays map<string,string>, findings array<string>"""
#: Fixed value: bytes of search text that are kept.
SEARCH_BYTES = 500_000


def manifests(v: Views) -> DataFrame:
    """The documents as manifests, one a record."""
    d = v.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")
    lab = v.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = d.join(lab, "doc_id", "left")
    s = F.col("doc_id").cast("string")
    return d.select(
        v.digest(F.col("text")).alias("digest"), F.concat(F.lit("doc:"), s).alias("object_id"), F.lit("text/plain").alias("media_type"), F.array("lang").alias("roles"), day.alias("created"), day.alias("updated"),
        F.array(
            F.struct(F.lit("document").alias("kind"), F.lit("document").alias("name"), F.lit("1").alias("version"), F.create_map(F.lit("chars"), F.col("n_chars").cast("string")).alias("metadata")),
            F.struct(F.lit(None).cast("string").alias("kind"), F.concat(F.lit("lang:"), "lang").alias("name"), F.lit("1").alias("version"), F.create_map(F.lit("lang"), "lang").alias("metadata")),
            F.struct(F.lit("document").alias("kind"), F.lit("document").alias("name"), F.lit("2").alias("version"), F.create_map(F.lit("chars"), F.col("n_chars").cast("string"), F.lit("source"), F.col("source")).alias("metadata")),
        ).alias("facets"),
        F.array(F.struct(F.substring("text", 1, 30).alias("value"), F.lit("text").alias("source"), F.lit(0.5).alias("confidence"))).alias("titles"),
        F.array(F.struct(F.lit("corpus").alias("source_kind"), F.col("source").alias("source_name"), s.alias("external_id"), F.lit("1").alias("version"))).alias("provenance"),
        F.array(F.struct(F.lit("from_source").alias("type"), F.concat(F.lit("doc:"), s).alias("from"), F.concat(F.lit("source:"), "source").alias("to"), F.lit("").alias("role"), F.lit(0).alias("ord"))).alias("relationships"),
        F.when(F.col("doc_id") % 10 == 0, F.array(F.struct(F.sha2(F.concat(F.lit("part:"), s), 256).alias("digest"), F.lit("body").alias("role"), F.lit(0).alias("ord")))).alias("parts"),
        F.array(F.struct(F.concat(F.lit("doc:"), s).alias("subject"), F.lit("written_in").alias("predicate"), F.col("lang").alias("object"))).alias("graph_facts"),
        F.array(F.col("lang"), F.col("source"), F.col("lang")).alias("keywords"),
        F.array(F.struct(F.lit("hash").alias("model"), F.lit("").alias("id"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(float("nan")).cast("float"), F.lit(1.0).cast("float"))).otherwise(F.array((F.col("doc_id") % 10).cast("float"), F.lit(1.0).cast("float"))).alias("vector"))).alias("embeddings"),
        F.filter(F.array(
            F.when(F.col("quality").isNotNull(), F.struct(F.lit("analysis").alias("kind"), F.lit("quality").alias("analyzer"), F.lit("1").alias("version"), day.alias("generated"), F.create_map(F.lit("status"), F.when(F.col("quality") == 0, "failed").otherwise(""), F.lit("summary"), F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("data"))),
            F.when(F.col("toxic").isNotNull(), F.struct(F.lit("note").alias("kind"), F.lit("toxicity").alias("analyzer"), F.lit("1").alias("version"), day.alias("generated"), F.create_map(F.lit("overlay.toxic"), F.col("toxic").cast("string")).alias("data"))),
        ), lambda x: x.isNotNull()).alias("annotations"),
        F.create_map(F.lit("seen"), (F.col("doc_id") % 2).cast("string")).alias("overlays"),
        F.when(F.col("doc_id") % 97 == 5, F.array(F.lit("unreadable"))).otherwise(F.array().cast("array<string>")).alias("findings"),
    )


def healthy(m: DataFrame) -> DataFrame:
    return m.where(F.size("findings") <= 0)


def objects(m: DataFrame) -> DataFrame:
    return healthy(m).select("digest", "object_id", "media_type", "created", "updated", F.coalesce(F.get(F.col("titles.value"), F.lit(0)), F.col("object_id")).alias("title"))


def facets(m: DataFrame) -> DataFrame:
    """Kind is the facet's kind or else its name; the last of a manifest's facets of a kind counts."""
    rows = healthy(m).select("digest", "object_id", F.posexplode("facets").alias("pos", "f")).withColumn("kind", F.coalesce("f.kind", "f.name"))
    last = rows.groupBy("digest", "object_id", "kind").agg(F.max_by("f", "pos").alias("f"))
    return last.select("digest", "object_id", "kind", "f.version", F.array_join(F.array_sort(F.transform(F.map_entries("f.metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("metadata"))


def provenance(m: DataFrame) -> DataFrame:
    return healthy(m).select("digest", F.inline("provenance"))


def relationships(m: DataFrame) -> DataFrame:
    """Declared edges, and `contains` and `part_of` for every part."""
    declared = healthy(m).select("digest", F.inline("relationships"))
    inner = healthy(m).where("parts is not null").select("digest", F.explode("parts").alias("p"))
    edge = lambda kind, a, b: inner.select("digest", F.lit(kind).alias("type"), a.alias("from"), b.alias("to"), F.col("p.role").alias("role"), F.col("p.ord").alias("ord"))
    return declared.unionByName(edge("contains", F.col("digest"), F.col("p.digest"))).unionByName(edge("part_of", F.col("p.digest"), F.col("digest"))).distinct()


def parts(m: DataFrame) -> DataFrame:
    return healthy(m).where("parts is not null").select("digest", F.explode("parts").alias("p")).select("digest", F.col("p.digest").alias("part_digest"), "p.role", "p.ord").distinct()


def analysis(m: DataFrame) -> DataFrame:
    """Annotations of kind analysis; an empty status is complete."""
    rows = healthy(m).select("digest", "object_id", F.explode("annotations").alias("a")).where("a.kind = 'analysis'")
    return rows.select("digest", "object_id", "a.analyzer", "a.version", F.coalesce(F.nullif(F.try_element_at("a.data", F.lit("status")), F.lit("")), F.lit("complete")).alias("status"))


def graph_edges(m: DataFrame) -> DataFrame:
    return healthy(m).select("digest", F.inline("graph_facts")).distinct()


def graph_nodes(m: DataFrame) -> DataFrame:
    return graph_edges(m).select(F.explode(F.array("subject", "object")).alias("node")).distinct()


def keywords(m: DataFrame) -> DataFrame:
    return healthy(m).select("digest", F.explode("keywords").alias("keyword")).where("keyword is not null").distinct()


def embeddings(m: DataFrame) -> DataFrame:
    """One row an embedding; its id or else the object's digest; a vector with NaN or an infinity is null."""
    rows = healthy(m).select("digest", "object_id", F.inline("embeddings"))
    bad = F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select("digest", "object_id", "model", F.coalesce(F.nullif("id", F.lit("")), "digest").alias("embedding_id"), F.when(~bad, F.size("vector")).alias("dims"))


def overlays(m: DataFrame) -> DataFrame:
    """The manifest's overlays and then the annotations' `overlay.` entries, the right one winning."""
    extra = F.map_from_entries(F.transform(F.filter(F.flatten(F.transform("annotations", lambda a: F.map_entries(a["data"]))), lambda e: F.startswith(e["key"], F.lit("overlay."))), lambda e: F.struct(F.substring(e["key"], 9, 1 << 20), e["value"])))
    both = F.map_entries(F.map_concat("overlays", extra))
    return healthy(m).select("digest", "object_id", F.array_join(F.array_sort(F.transform(both, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("overlay"))


def summaries(m: DataFrame) -> DataFrame:
    rows = healthy(m).select("digest", "object_id", F.explode("annotations").alias("a"))
    return rows.select("digest", "object_id", F.col("a.analyzer").alias("kind"), F.try_element_at("a.data", F.lit("summary")).alias("summary")).where("summary is not null and summary <> ''")


def byte_prefix(c: Column, most: int) -> Column:
    """The longest prefix of whole characters with `most` bytes at most: cut by bytes, then a broken last character is dropped."""
    raw = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(raw, "\ufffd+$", ""))


def search_text(m: DataFrame, most: int = SEARCH_BYTES) -> DataFrame:
    """What full-text search sees of an object: id, type, roles, keywords, titles, facets and sources as lines, without NUL."""
    text = F.concat_ws(
        "\n", "object_id", "media_type", F.array_join("roles", " "), F.array_join("keywords", " "), F.array_join(F.col("titles.value"), " "),
        F.array_join(F.transform("facets", lambda f: F.concat_ws(" ", f["kind"], f["name"])), " "), F.array_join(F.transform("provenance", lambda p: F.concat_ws(" ", p["source_kind"], p["source_name"], p["external_id"])), " "),
    )
    return healthy(m).select("object_id", byte_prefix(F.translate(text, "\u0000", ""), most).alias("search_text"))


def findings(m: DataFrame) -> DataFrame:
    """State rows of objects that could not be read; these have no projection."""
    return m.where(F.size("findings") > 0).select(F.concat(F.lit("findings:"), "digest").alias("key"), "object_id", F.array_join("findings", ",").alias("state"))


TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "objects": objects, "facets": facets, "provenance": provenance, "relationships": relationships, "parts": parts, "analysis": analysis, "graph_edges": graph_edges, "graph_nodes": graph_nodes,
    "keywords": keywords, "embeddings": embeddings, "overlays": overlays, "summaries": summaries, "search_text": search_text, "findings": findings,
}


def rebuild(m: DataFrame, folder: str, changed_since: str | None = None) -> DataFrame:
    """Write every table below the folder and report (table, rows). With changed_since only manifests updated after it, as an own version beside the last."""
    if changed_since:
        m = m.where(F.col("updated") > F.lit(changed_since).cast("timestamp_ntz"))
    m = written(m, "manifests")  # every table reads the manifests; their sources are read once
    counts = []
    for name, project in TABLES.items():
        path = f"{folder}/{name}"
        project(m).write.mode("overwrite").parquet(path)
        counts.append((name, m.sparkSession.read.parquet(path).count()))
    return m.sparkSession.createDataFrame(counts, "table string, rows bigint")


def merge(m: DataFrame) -> DataFrame:
    """One manifest a digest: roles united, facets by kind with the highest version, provenance by its four parts, ids and times widest.

    Lists are united as sets or aggregated after an explode, so no state grows beyond what a merged manifest itself holds.
    """
    head = m.groupBy("digest").agg(F.min("object_id").alias("object_id"), F.min("created").alias("created"), F.max("updated").alias("updated"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))), ",").alias("roles"), F.count("*").alias("records"))
    kinds = facets(m).groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("@", "kind", "version"))), ",").alias("facets"))
    sources = provenance(m).groupBy("digest").agg(F.count_distinct("source_kind", "source_name", "external_id", "version").alias("sources"))
    return head.join(kinds, "digest", "left").join(sources, "digest", "left").select("digest", "object_id", "created", "updated", "roles", "records", F.coalesce("facets", F.lit("")).alias("facets"), F.coalesce("sources", F.lit(0)).alias("sources"))
