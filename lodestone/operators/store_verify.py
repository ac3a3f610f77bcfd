"""Verification of a store: manifests, blobs, recovery records and compound objects, whose digests are recomputed from their parts upwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.fixpoint import written
from lodestone.plans.views import Views

#: The codes of findings.
CODES = (
    "manifest_missing_facets", "manifest_digest_mismatch", "blob_read_failed", "blob_digest_mismatch", "compound_invalid_part", "compound_dangling_part", "compound_digest_mismatch",
    "recovery_missing", "recovery_digest_mismatch", "recovery_uncompressed_hash_mismatch", "recovery_compressed_size_mismatch", "recovery_compressed_hash_mismatch", "source_index_missing",
)


def compound_digest(parts) -> F.Column:
    """The digest of a compound object from its ordered parts (ord, role, digest)."""
    return F.sha2(F.concat(F.lit("compound\n"), F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["role"], p["digest"])), "\n")).cast("binary"), 256)


def recomputed(blobs: DataFrame, parts: DataFrame) -> DataFrame:
    """object, actual: the digests that contents give. blobs: object, content; parts: object, part (an object), role, ord.

    Blobs are hashed first, then in each round the compounds all of whose parts have a digest by now, so one wrong blob shows in all
    that contain it. Objects in a cycle, or with a part that has no content, get none. Rounds are as many as objects are nested.
    """
    known = written(blobs.where("content is not null").select("object", F.sha2(F.col("content").cast("binary"), 256).alias("actual")), "verified")
    sizes = written(parts.groupBy("object").agg(F.count("*").alias("n")), "compound-sizes")
    done, fresh = [known], known
    waiting = written(parts.join(sizes, "object"), "compound-parts")
    held = None
    while fresh.limit(1).count():
        more = waiting.join(fresh.select(F.col("object").alias("part"), "actual"), "part").select("object", "n", "ord", "role", "actual")
        held = written(more if held is None else held.unionByName(more), "compound-held")  # parts of compounds that wait for others
        by = held.groupBy("object").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("ord", "role", F.col("actual").alias("digest")))).alias("ps"))
        fresh = written(by.where(F.size("ps") == F.col("n")).select("object", compound_digest(F.col("ps")).alias("actual")), "compounds")
        held = held.join(fresh, "object", "left_anti")
        done.append(fresh)
    return reduce(DataFrame.unionByName, done)


def findings(manifests: DataFrame, blobs: DataFrame, parts: DataFrame, recovery: DataFrame, sources: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """object, code: what is wrong with a store, each finding once.

    manifests: object, digest (which names the store's entry), manifest_digest (which the manifest itself states), compound, facets
    (how many). blobs: object, content, compressed. parts: object, part, role, ord. recovery: object, digest, uncompressed (hash),
    size and compressed (of the compressed content). sources: object. Each check is a plan of its own; joins are by object.
    """
    found = lambda df, code: df.select("object", F.lit(code).alias("code"))
    m = manifests
    simple = m.where("not compound")
    real = written(recomputed(blobs, parts), "recomputed")
    stated = m.join(real, "object")
    r = recovery.join(m.select("object", F.col("digest").alias("entry")), "object").join(blobs, "object", "left")
    size, hash_of = F.octet_length("compressed_content"), F.sha2("compressed_content", 256)
    r = r.withColumnRenamed("compressed", "compressed_hash").withColumnRenamed("compressed_bytes", "compressed_content")
    known = m.select(F.col("object").alias("part"))
    checks = [
        found(m.where("facets = 0"), "manifest_missing_facets"),
        found(m.where(~F.col("digest").eqNullSafe(F.col("manifest_digest"))), "manifest_digest_mismatch"),
        found(simple.join(blobs.where("content is not null"), "object", "left_anti"), "blob_read_failed"),
        found(stated.where("not compound and actual != digest"), "blob_digest_mismatch"),
        found(parts.where(F.col("role").isNull() | ~F.col("role").isin(*roles) | (F.col("ord") < 0)), "compound_invalid_part"),
        found(parts.join(known, "part", "left_anti"), "compound_dangling_part"),
        found(stated.where("compound and actual != digest"), "compound_digest_mismatch"),
        found(simple.join(recovery, "object", "left_anti"), "recovery_missing"),
        found(r.where(F.col("digest") != F.col("entry")), "recovery_digest_mismatch"),
        found(r.where(F.col("content").isNotNull() & (F.col("uncompressed") != F.sha2(F.col("content").cast("binary"), 256))), "recovery_uncompressed_hash_mismatch"),
        found(r.where(size != F.col("size")), "recovery_compressed_size_mismatch"),
        found(r.where(hash_of != F.col("compressed_hash")), "recovery_compressed_hash_mismatch"),
        found(simple.join(sources, "object", "left_anti"), "source_index_missing"),
    ]
    return reduce(DataFrame.unionByName, checks).distinct()


def store(v: Views) -> dict[str, DataFrame]:
    """The conversations as a store: turns are blobs, threads compounds of them, and what is damaged by a rule: every 11th thread states
    another digest, every 7th turn's recovery record another size, assistants' turns of every 13th thread have none."""
    c = v.table("conversations")
    turn = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    text = F.coalesce("text", F.lit(""))
    rows = c.select(turn.alias("object"), F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("thread"), "conv_id", "turn", "role", text.alias("content"), F.sha2(text.cast("binary"), 256).alias("digest"))
    blobs = rows.select("object", "content", F.col("content").cast("binary").alias("compressed_bytes"))
    parts = rows.select(F.col("thread").alias("object"), F.col("object").alias("part"), "role", F.col("turn").alias("ord"))
    whole = rows.groupBy("thread", "conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("ord"), "role", "digest"))).alias("ps"))
    stated = F.when(F.col("conv_id") % 11 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(compound_digest(F.col("ps")))
    threads = whole.select(F.col("thread").alias("object"), stated.alias("digest"), stated.alias("manifest_digest"), F.lit(True).alias("compound"), F.lit(1).alias("facets"))
    manifests = rows.select("object", "digest", F.col("digest").alias("manifest_digest"), F.lit(False).alias("compound"), F.lit(1).alias("facets")).unionByName(threads)
    size = F.octet_length("content") + F.when(F.col("turn") % 7 == 6, 1).otherwise(0)
    kept = rows.where("not (role = 'assistant' and conv_id % 13 = 0)")
    recovery = kept.select("object", "digest", F.col("digest").alias("uncompressed"), size.alias("size"), F.col("digest").alias("compressed"))
    return {"manifests": manifests, "blobs": blobs, "parts": parts, "recovery": recovery, "sources": rows.select("object")}


def store_findings(v: Views) -> DataFrame:
    return findings(**store(v), roles=("user", "assistant", "system"))


SQL = {
    "store_findings": """WITH c AS (SELECT 'turn:' || conv_id || ':' || turn AS object, 'conv:' || conv_id AS thread, conv_id, turn, role FROM conversations)
SELECT DISTINCT thread AS object, 'compound_digest_mismatch' AS code FROM c WHERE conv_id % 11 = 0
UNION SELECT object, 'recovery_compressed_size_mismatch' FROM c WHERE turn % 7 = 6 AND NOT (role = 'assistant' AND conv_id % 13 = 0)
UNION SELECT object, 'recovery_missing' FROM c WHERE role = 'assistant' AND conv_id % 13 = 0
UNION SELECT thread, 'compound_invalid_part' FROM c WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'system') OR turn < 0"""
}
