"""State that operations leave: mail states, cursors, claims, stored embeddings, merged manifests and annotations, deletions, parents, queues, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import collapse, sha256_hex
from lodestone.operators.common import best_per_key, norm_limit, paged, sorted_set
from lodestone.plans.fixpoint import reachable, written
from lodestone.plans.views import Views

SATISFIED = ("complete", "skipped")
#: How far versions of a mail differ, the least first.
SCALES = ("trivial", "minor", "major")


def email_updates(v: Views) -> DataFrame:
    """position, email_id, mailboxes, keywords: each click asks for a mail to lie in other mailboxes with other keywords."""
    e = v.table("events").where("event_type = 'click'")
    boxes = F.when(F.col("value") > 100, F.array(F.lit(""))).when(F.col("value") > 50, F.array(F.lit("archive"), F.lit(""), F.lit("all"), F.lit("archive"))).otherwise(F.array(F.lit("inbox")))
    words = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("$seen"), F.lit("$flagged"), F.lit("$seen"))).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("event_id").alias("position"), F.concat(F.lit("turn:"), (F.col("user_id") % 60).cast("string"), F.lit(":"), (F.col("event_id") % 12).cast("string")).alias("email_id"), boxes.alias("mailboxes"), words.alias("keywords"))


def updated_emails(states: DataFrame, updates: DataFrame) -> DataFrame:
    """email_id, mailboxes, keywords, sequence, rejected of every state (email_id, mailboxes, keywords) after the updates, in their order.

    An update replaces both sets, as sorted distinct names without blank ones, and raises the sequence by one; one without a
    mailbox, or of an unknown mail, changes nothing and is counted as rejected.
    """
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(c, F.trim), lambda x: x != "")))
    u = updates.select("position", "email_id", clean("mailboxes").alias("m"), clean("keywords").alias("k")).withColumn("good", F.size("m") > 0)
    last = u.groupBy("email_id").agg(F.max(F.when(F.col("good"), F.struct("position", "m", "k"))).alias("x"), F.count_if("good").alias("sequence"), F.count_if(~F.col("good")).alias("rejected"))
    out = states.join(last, "email_id", "left")
    text = lambda c: F.array_join(c, ",")
    return out.select("email_id", text(F.coalesce("x.m", "mailboxes")).alias("mailboxes"), text(F.coalesce("x.k", "keywords")).alias("keywords"), F.coalesce("sequence", F.lit(0)).alias("sequence"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


def requested_emails(v: Views, ids: Sequence[str]) -> DataFrame:
    """id, found, thread_id, mailbox of the asked mails, each once; those that don't exist are not found."""
    asked = v.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    e = v.emails().select(F.col("email_id").alias("id"), F.lit(True).alias("found"), "thread_id", "mailbox")
    return asked.join(e, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), "thread_id", "mailbox")


def project_object(v: Views, digests: DataFrame) -> DataFrame:
    """digest, object_id, media_type, facets, sources of the asked digests alone (column digest)."""
    asked = digests.select("digest").distinct()
    pick = lambda df: df.join(asked, "digest", "left_semi")
    kinds = pick(v.facets()).groupBy("digest").agg(F.array_join(sorted_set("kind"), ",").alias("facets"))
    sources = pick(v.provenance()).groupBy("digest").agg(F.count("*").alias("sources"))
    out = pick(v.records()).groupBy("digest").agg(F.min("object_id").alias("object_id"), F.min("media_type").alias("media_type"))
    return out.join(kinds, "digest", "left").join(sources, "digest", "left").select("digest", "object_id", "media_type", F.coalesce("facets", F.lit("")).alias("facets"), F.coalesce("sources", F.lit(0)).alias("sources"))


def cursors(reports: DataFrame) -> DataFrame:
    """source_name, source_kind, cursor, updated: the last report of each name, whatever kind it is of (names collide across kinds)."""
    return best_per_key(reports, ["source_name"], [F.desc("updated"), F.desc("cursor")])


def cursor_reports(v: Views) -> DataFrame:
    e = v.table("events")
    return e.select(F.concat(F.lit("source"), (F.col("user_id") % 20).cast("string")).alias("source_name"), F.col("event_type").alias("source_kind"), F.col("event_id").alias("cursor"), F.col("ts").alias("updated"))


def granted_claims(attempts: DataFrame, ttl_seconds: int = 15 * 60) -> DataFrame:
    """ref, id, claimed of the attempts (ref, id, at) that get a claim: the first of each ref, then the first more than ttl_seconds after the last claim.

    Each attempt knows the next one that could follow it; from the first on these steps are followed two, four, eight at a time.
    """
    at = attempts.withColumn("s", F.unix_micros(F.col("at").cast("timestamp")))
    order = W.partitionBy("ref").orderBy("s", "id")
    live = W.partitionBy("ref").orderBy("s").rangeBetween(0, ttl_seconds * 1_000_000)
    after = written(at.withColumn("i", F.row_number().over(order)).withColumn("next", F.max("i").over(live) + 1), "attempts")
    jump = after.select("ref", "i", F.col("next"))
    got = written(after.where("i = 1").select("ref", "i"), "claims")
    while True:
        more = got.join(jump, ["ref", "i"]).select("ref", F.col("next").alias("i")).join(after.select("ref", "i"), ["ref", "i"], "left_semi")
        more = written(more.join(got, ["ref", "i"], "left_anti"), "claims")
        if not more.limit(1).count():
            break
        got = written(got.unionByName(more), "claims")
        far = jump.select("ref", F.col("i").alias("next"), F.col("next").alias("far"))
        jump = written(jump.join(far, ["ref", "next"], "left").select("ref", "i", F.coalesce("far", "next").alias("next")), "jumps")
    return after.join(got, ["ref", "i"], "left_semi").select("ref", "id", F.col("at").alias("claimed"))


def stored_embeddings(upserts: DataFrame) -> DataFrame:
    """contact_id, model, embedding_id, dims: what upserts (position, contact_id, model, status, vector) leave, in their order.

    A complete one with a vector replaces the contact's vector of the model; any other takes it away.
    """
    last = upserts.groupBy("contact_id", "model").agg(F.max(F.struct("position", F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("complete")).alias("status"), "vector")).alias("x"))
    return last.where("x.status = 'complete' and size(x.vector) > 0").select("contact_id", "model", F.concat_ws(":", "contact_id", "model", F.col("x.position").cast("string")).alias("embedding_id"), F.size("x.vector").alias("dims"))


def embedding_upserts(v: Views) -> DataFrame:
    e = v.table("embeddings")
    status = F.when(F.col("vec_id") % 5 == 0, "failed").when(F.col("vec_id") % 5 == 1, " ").otherwise("complete")
    vector = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return e.select(F.col("vec_id").alias("position"), F.concat(F.lit("contact:c"), (F.col("vec_id") % 50).cast("string")).alias("contact_id"), F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")).alias("model"), status.alias("status"), vector.alias("vector"))


def merged_annotations(annotations: DataFrame) -> DataFrame:
    """digest, kind, analyzer, data, satisfied of annotations (position, digest, kind, analyzer, data): maps united, the later value winning."""
    keys = ["digest", "kind", "analyzer"]
    cells = annotations.select("position", *keys, F.explode("data").alias("key", "value")).groupBy(*keys, "key").agg(F.max_by("value", "position").alias("value"))
    out = cells.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), "value"))), ";").alias("data"), F.max(F.when(F.col("key") == "status", F.col("value"))).alias("status"))
    return out.select(*keys, "data", F.coalesce(F.col("status").isin(*SATISFIED), F.lit(False)).alias("satisfied"))


def annotation_rows(v: Views) -> DataFrame:
    """Two annotations of each labelled document: an analysis, and a later one with part of its data anew."""
    rows = v.table("labels").join(v.table("documents").select("doc_id", "text"), "doc_id").select(v.digest(F.col("text")).alias("digest"), "doc_id", "quality", "toxic")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    first = rows.select((F.col("doc_id") * 2).alias("position"), "digest", F.lit("analysis").alias("kind"), F.lit("quality").alias("analyzer"), F.create_map(F.lit("status"), F.lit("failed"), F.lit("quality"), text("quality")).alias("data"))
    again = rows.where("doc_id % 3 <> 0").select((F.col("doc_id") * 2 + 1).alias("position"), "digest", F.lit("analysis").alias("kind"), F.lit("quality").alias("analyzer"), F.create_map(F.lit("status"), F.when(F.col("doc_id") % 3 == 1, "complete").otherwise("skipped"), F.lit("toxic"), text("toxic")).alias("data"))
    return first.unionByName(again)


def merged_records(v: Views) -> DataFrame:
    """digest, version_count, max_scale, collision, canonical, sources, body, parts: one mail manifest of all records of a text, in order of id.

    Facet data is united, the later value winning, but the largest version count and the widest scale stay, any collision stays,
    and the canonical version is that of the largest count, the last of equal ones. Provenance is united by its four parts, the
    first winning. A part's slot is its role and place: the last record that fills one wins.
    """
    d = v.table("documents").select("doc_id", "source", "lang", v.digest(F.col("text")).alias("digest"))
    count = F.col("doc_id") % 5
    scale = F.element_at(F.array(*[F.lit(s) for s in SCALES]), (F.col("doc_id") % 3 + 1).cast("int"))
    rank = F.array_position(F.array(*[F.lit(s) for s in SCALES]), scale)
    head = d.groupBy("digest").agg(
        F.max(count).alias("version_count"), F.max(F.struct(rank.alias("r"), scale.alias("s")))["s"].alias("max_scale"), F.bool_or(F.col("doc_id") % 4 == 0).alias("collision"),
        F.max(F.struct(count.alias("c"), "doc_id"))["doc_id"].alias("canonical"), F.max_by("lang", "doc_id").alias("body"),
    )
    provenance = d.groupBy("digest", "source", (F.col("doc_id") % 2).alias("version")).agg(F.min("doc_id").alias("first")).groupBy("digest").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "source", F.col("version").cast("string"), F.col("first").cast("string")))), ",").alias("sources"))
    slots = d.select("digest", "doc_id", F.explode(F.array(F.struct(F.lit("body").alias("role"), F.lit(0).cast("long").alias("ord")), F.struct(F.lit("attachment").alias("role"), (F.col("doc_id") % 2).alias("ord")))).alias("p"))
    filled = slots.groupBy("digest", "p.role", "p.ord").agg(F.max("doc_id").alias("part")).groupBy("digest").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "role", F.col("ord").cast("string"), F.col("part").cast("string")))), ",").alias("parts"))
    return head.join(provenance, "digest").join(filled, "digest")


def delete_report(v: Views, source: str) -> DataFrame:
    """scanned, deleted, detached of taking one source away: objects with no other source go, the others lose that source's rows."""
    rows = v.table("documents").select(v.digest(F.col("text")).alias("digest"), "source")
    per = rows.groupBy("digest").agg(F.count_if(F.col("source") == source).alias("own"), F.count_if(F.col("source") != source).alias("others"))
    return per.agg(F.count("*").alias("scanned"), F.count_if((F.col("own") > 0) & (F.col("others") == 0)).alias("deleted"), F.coalesce(F.sum("own"), F.lit(0)).alias("detached"))


def delete_object(v: Views, digests: DataFrame) -> DataFrame:
    """digest, kind, rows: what goes with deleted objects (column digest): manifest, annotations, and those index rows that still point at them."""
    gone = digests.select("digest").distinct()
    pages = v.table("pages").select(F.regexp_replace("url", r"\?.*$", "").alias("ref"), v.digest(F.col("html")).alias("digest"), "page_id")
    alias = best_per_key(pages, ["ref"], [F.desc("page_id")])  # a source's row points at its newest object
    count = lambda df, kind: df.join(gone, "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("rows")).select("digest", F.lit(kind).alias("kind"), "rows")
    return count(v.objects(), "manifest").unionByName(count(v.analysis(), "annotation")).unionByName(count(alias, "source_index"))


def parent_summaries(v: Views) -> DataFrame:
    """parent, part, analyzer, version, status: what each whole, here a source, is told of its parts' analyses."""
    parents = v.table("documents").select(v.digest(F.col("text")).alias("digest"), F.concat(F.lit("source:"), "source").alias("parent")).distinct()
    return parents.join(v.analysis(), "digest").select("parent", F.col("digest").alias("part"), "analyzer", "version", "status")


def compound_parents(v: Views) -> DataFrame:
    """part, parents, uses: by how many wholes, and in how many places, a part is held."""
    return v.parts().groupBy(F.col("part_digest").alias("part")).agg(F.count_distinct("digest").alias("parents"), F.count("*").alias("uses"))


def recursive_storage(v: Views) -> DataFrame:
    """root, objects, bytes of every binder: all that it holds, however deep, each object once."""
    from lodestone.operators.mailbox import containment

    edges = containment(v).select(F.col("target").alias("source"), F.col("source").alias("target"))
    seeds = edges.where("source like 'binder:%'").select(F.col("source").alias("seed")).distinct()
    turn = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    size = v.table("conversations").groupBy(turn.alias("node")).agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).cast("long").alias("bytes"))
    held = reachable(seeds, edges, include_seeds=False).join(size, "node", "left")
    return held.groupBy(F.col("seed").alias("root")).agg(F.count("*").alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def worker_branches(v: Views, unavailable: Sequence[str] = ("outline",)) -> DataFrame:
    """analyzer, branch, n: what becomes of each queued job: dropped (its object is gone), parked (no such analyzer now), skipped (done in
    this version, not forced) or run."""
    from lodestone.operators.jobs import SPECS, derive

    due = derive(v, forced=["toxicity"]).select("digest", "analyzer", "version", "reason")
    done = v.analysis().select("digest", "analyzer", F.col("version").alias("have"), "status")
    extra = v.table("benchmark").select(v.digest(F.col("text")).alias("digest"), F.lit("quality").alias("analyzer"), F.lit("1").alias("version"), F.lit("missing").alias("reason"))
    repeated = done.where("analyzer = 'quality' and status = 'complete'").select("digest", "analyzer", F.col("have").alias("version"), F.lit("missing").alias("reason"))
    queue = due.unionByName(extra).unionByName(repeated)
    rows = queue.join(v.objects().select("digest", F.lit(True).alias("there")), "digest", "left").join(done, ["digest", "analyzer"], "left")
    satisfied = (F.col("have") == F.col("version")) & F.col("status").isin(*SATISFIED) & (F.col("reason") != "forced")
    branch = F.when(F.col("there").isNull(), "dropped").when(F.col("analyzer").isin(*unavailable), "parked").when(F.coalesce(satisfied, F.lit(False)), "skipped").otherwise("run")
    assert {a for a, _, _ in SPECS} >= set(unavailable)
    return rows.groupBy("analyzer", branch.alias("branch")).agg(F.count("*").alias("n"))


def backfill_page(v: Views, cursor: tuple[str, int] | None = None, limit: int | None = None) -> DataFrame:
    """source, doc_id of the next records after a cursor (source, doc_id) in that order; the last row is the next cursor."""
    d = v.table("documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id")
    if cursor:
        d = d.where((F.col("source") > cursor[0]) | ((F.col("source") == cursor[0]) & (F.col("doc_id") > cursor[1])))
    return d.orderBy("source", "doc_id").limit(norm_limit(limit, 200, 10_000))


def import_queue(v: Views) -> DataFrame:
    """item, state, attempts of each queued file after all its events: its last state; what is not done is resumed in this order."""
    e = v.table("events").select(F.col("user_id").alias("item"), "ts", "event_id", F.when(F.col("event_type") == "purchase", "done").when(F.col("value") > 100, "failed").otherwise("running").alias("state"))
    last = e.groupBy("item").agg(F.max_by("state", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("state") == "running").alias("attempts"))
    return last.select("item", F.when(F.col("last") == "done", "done").when(F.col("last") == "failed", "failed").otherwise("resume").alias("state"), "attempts")


def metrics(v: Views) -> DataFrame:
    """name, value as a scrape shows them: counters with their totals, gauges with their last value, durations with sum and count."""
    e = v.table("events").select(F.concat(F.lit("events_"), F.regexp_replace(F.lower("event_type"), "[^a-z0-9_]", "_")).alias("name"), "value", "ts", "event_id")
    counter = e.groupBy("name").agg(F.count("*").cast("double").alias("value")).select(F.concat("name", F.lit("_total")).alias("name"), "value")
    gauge = e.groupBy("name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    spans = e.groupBy("name").agg(F.round(F.sum("value"), 4).alias("sum"), F.count("*").cast("double").alias("count"))
    parts = spans.select(F.explode(F.array(F.struct(F.concat("name", F.lit("_seconds_sum")).alias("name"), F.col("sum").alias("value")), F.struct(F.concat("name", F.lit("_seconds_count")).alias("name"), F.col("count").alias("value")))).alias("x")).select("x.*")
    return counter.unionByName(gauge).unionByName(parts)


def resolved_identity(v: Views, identity: str, limit: int | None = None) -> DataFrame:
    """digest, total_count: the distinct objects of one identity (a message's normal id), a page of them in order."""
    mid = F.lower(F.concat(F.lit("doc-"), F.regexp_replace(F.substring("text", 1, 6), "[^A-Za-z]", "")))
    d = v.table("documents").where(mid == identity.strip().lower()).select(v.digest(F.col("text")).alias("digest")).distinct()
    return paged(d, [F.col("digest")], limit)


def subject_identity(text) -> F.Column:
    """The id that a message without one gets: a hash of its subject, the whole first line, in lower case and with white space collapsed."""
    return sha256_hex(collapse(F.lower(F.get(F.split(F.coalesce(text, F.lit("")), "\n", 2), F.lit(0)))))


def identity_of(v: Views, doc_id: int, limit: int | None = None) -> DataFrame:
    """digest, total_count: the distinct objects with the identity of a given one, a page of them in order."""
    d = v.table("documents").select("doc_id", subject_identity(F.col("text")).alias("identity"), v.digest(F.col("text")).alias("digest"))
    asked = d.where(F.col("doc_id") == doc_id).select("identity").distinct()
    return paged(d.join(asked, "identity", "left_semi").select("digest").distinct(), [F.col("digest")], limit)


class Registry:
    """Analyzers by name and version; a name without either, or both twice, is an error."""

    def __init__(self, *analyzers: tuple[str, str, object]):
        self.known: dict[tuple[str, str], object] = {}
        for name, version, run in analyzers:
            key = (name.strip(), version.strip())
            if not all(key):
                raise ValueError(f"an analyzer needs a name and a version: {key}")
            if key in self.known:
                raise ValueError(f"analyzer {key} is registered twice")
            self.known[key] = run

    def specs(self) -> list[tuple[str, str]]:
        return sorted(self.known)

    def get(self, name: str, version: str):
        return self.known.get((name.strip(), version.strip()))


def embedding_batches(texts: Sequence[str], most: int = 12, most_tokens: int = 1500) -> list[list[int]]:
    """Positions of texts in calls of at most `most` texts and most_tokens tokens (a quarter of the characters); a longer text goes alone."""
    out: list[list[int]] = []
    used = 0
    for i, t in enumerate(texts):
        need = max(1, (len(t) + 3) // 4)
        if not out or len(out[-1]) >= most or used + need > most_tokens:
            out.append([])
            used = 0
        out[-1].append(i)
        used += need
    return out


def uncached(wanted: DataFrame, cache: DataFrame, namespace: str) -> DataFrame:
    """key, text of the wanted texts (key, text) that the cache (namespace, key) lacks in a namespace, each once."""
    return wanted.join(cache.where(F.col("namespace") == namespace).select("key"), "key", "left_anti").dropDuplicates(["key"])


def snapshot(state: dict[str, DataFrame], folder: str) -> None:
    """Write every table of a resolver's state below a new folder."""
    for name, df in state.items():
        df.write.parquet(f"{folder}/{name}")


def restore(spark, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
