"""Contacts from typed statements: registered concepts, facts, owners of sub-nodes, selection policies, validity, emitted parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import structured as st
from lodestone.functions import vocabulary as vo
from lodestone.functions.text import collapse, email, name_tokens, phone, url
from lodestone.operators.common import best_per_key
from lodestone.plans.views import Views

#: What the nodes begin with whose literals belong to the contact that links them.
SUBNODES = ("urn:addr:", "urn:place:", "urn:name:")
#: Sources of the bound statements.
BUNDLES = 40


def statements(v: Views) -> DataFrame:
    """source, subject, predicate, object, object_kind: the customers as typed statements of BUNDLES sources, with address and name nodes."""
    k = F.col("c_custkey")
    s = k.cast("string")
    me = F.concat(F.lit("contact:c"), s)
    person = F.element_at(F.array(*[F.lit(x) for x in (vo.iri("foaf:Person"), "http://schema.org/Person", vo.iri("schema:Organization"), "urn:other:Thing")]), (k % 4 + 1).cast("int"))
    row = lambda subject, predicate, value, kind="literal", when=F.lit(True): F.when(when, F.struct(subject.alias("subject"), F.lit(predicate).alias("predicate"), value.alias("object"), F.lit(kind).alias("object_kind")))
    addr, name = F.concat(F.lit("urn:addr:"), s), F.concat(F.lit("urn:name:"), s)
    rows = F.array(
        row(me, vo.RDF_TYPE, person, "iri"),
        row(me, "http://schema.org/name", F.concat(F.lit(" "), F.col("c_name"))),
        row(me, vo.iri("foaf:mbox"), F.when(k % 50 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("mailto:P"), s, F.lit("@Mail.Example"))), "iri"),
        row(me, vo.iri("schema:worksFor"), F.col("c_mktsegment")),
        row(me, vo.iri("own:historicalEmail"), F.concat(F.lit("p"), s, F.lit("@old.example"))),
        row(me, vo.iri("own:hasContactPoint"), addr, "iri"),
        row(addr, vo.iri("own:addressLocality"), F.col("n_name")),
        row(addr, vo.iri("own:countryCode"), F.lit(" ")),
        row(me, vo.iri("own:hasName"), name, "iri"),
        row(name, vo.iri("own:fullName"), F.upper("c_name")),
        row(name, vo.iri("own:displayable"), F.lit("False"), when=k % 7 == 0),
        row(me, vo.iri("foaf:knows"), F.concat(F.lit("contact:c"), (k + BUNDLES).cast("string")), "iri"),
        row(me, vo.iri("foaf:age"), F.lit("42")),
    )
    c = v.spread("customer", "c_custkey").join(F.broadcast(v.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: 25 rows by the schema
    return c.select(F.concat(F.lit("bundle:"), (k % BUNDLES).cast("string")).alias("source"), F.inline(F.filter(rows, lambda x: x.isNotNull())))


def policies(v: Views) -> DataFrame:
    """source, roots, infer: a source names its contacts itself, has them inferred, or neither."""
    b = v.spark.range(BUNDLES)
    return b.select(F.concat(F.lit("bundle:"), F.col("id").cast("string")).alias("source"), F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit("contact:c"), F.col("id").cast("string")), F.lit("contact:guest"))).otherwise(F.array().cast("array<string>")).alias("roots"), (F.col("id") % 3 == 1).alias("infer"))


def typed_contacts(s: DataFrame) -> DataFrame:
    """source, contact: subjects whose type is one of a contact."""
    return s.where((F.col("predicate") == vo.RDF_TYPE) & vo.is_contact_type(F.col("object"))).select("source", F.col("subject").alias("contact")).distinct()


def selected(s: DataFrame, policy: DataFrame) -> DataFrame:
    """source, contact, rule: a source's named roots, else, where they are to be inferred, typed subjects that nothing in the source
    points to, else (or where there are none) all typed subjects."""
    typed = typed_contacts(s)
    named = policy.select("source", F.explode(F.filter(F.array_distinct("roots"), lambda x: x != "")).alias("contact"))
    used = s.select("source", F.col("object").alias("contact")).distinct()
    roots = typed.join(policy.where("infer").select("source"), "source", "left_semi").join(used, ["source", "contact"], "left_anti")
    roots = roots.join(named.select("source"), "source", "left_anti")
    decided = named.select("source").unionByName(roots.select("source")).distinct()
    rest = typed.join(decided, "source", "left_anti")
    rule = lambda df, name: df.select("source", "contact", F.lit(name).alias("rule"))
    return rule(named, "explicit").unionByName(rule(roots, "inferred")).unionByName(rule(rest, "typed"))


def facts(s: DataFrame, contacts: DataFrame, *more: str) -> DataFrame:
    """source, contact, kind, value, predicate, historical (and more columns of s) of the contacts (source, contact).

    Literals of a linked address, place or name node belong to the contact that links it; those of a name that is not to be
    displayed are left out. Mail addresses are normalised and dropped where they are none, other values trimmed, blank ones dropped.
    """
    kinds = vo.fact_kinds_table(s.sparkSession).withColumnRenamed("predicate", "known")
    link = s.where("object_kind = 'iri'").where(F.exists(F.array(*[F.lit(p) for p in SUBNODES]), lambda p: F.startswith(F.col("object"), p)))
    owners = link.join(contacts.withColumnRenamed("contact", "subject"), ["source", "subject"], "left_semi").groupBy("source", F.col("object").alias("subject")).agg(F.max("subject").alias("owner"))
    owners = owners.unionByName(contacts.select("source", F.col("contact").alias("subject"), F.col("contact").alias("owner")).distinct())
    hidden = s.where((F.col("predicate") == vo.iri("own:displayable")) & (F.lower(F.trim("object")) == "false")).select("source", "subject").distinct()
    rows = s.join(F.broadcast(kinds), vo.canonical(F.col("predicate")) == F.col("known"))  # the vocabulary
    rows = rows.join(owners, ["source", "subject"]).join(hidden, ["source", "subject"], "left_anti")
    address = email(F.col("object"))
    value = F.when(F.col("kind") == "email", F.when(address.rlike("^.+@[^@]+$"), address).otherwise("")).otherwise(F.trim("object"))
    return rows.select("source", F.col("owner").alias("contact"), "kind", value.alias("value"), "predicate", "historical", *more).where("value <> ''")


def annotations(s: DataFrame) -> DataFrame:
    """source, subject, predicate, object, ord, note, note_value: when addresses and employers of some customers held, in the order in which it was said."""
    k = F.regexp_extract("subject", "([0-9]+)$", 1).cast("bigint")
    row = lambda i, name, value, when: F.when(when, F.struct(F.lit(i).alias("ord"), F.lit(vo.iri(name)).alias("note"), F.lit(value).alias("note_value")))
    notes = F.array(row(2, "own:validFrom", "2001", k % 5 == 0), row(1, "time:hasBeginning", "1999", k % 5 < 2), row(3, "own:validUntil", "2010", k % 10 == 0), row(4, "own:displayable", "2020", F.lit(True)))
    return s.where(F.col("predicate").isin(vo.iri("foaf:mbox"), vo.iri("schema:worksFor"))).select("source", "subject", "predicate", "object", F.inline(F.filter(notes, lambda x: x.isNotNull())))


def timed_facts(s: DataFrame, contacts: DataFrame, notes: DataFrame) -> DataFrame:
    """source, contact, kind, value, predicate, historical, valid_from, valid_until of the contacts' facts, the strongest of equal ones.

    notes are annotations of statements: source, subject, predicate, object name the statement, note and note_value say something of it,
    ord in which order. A note that ends in hasBeginning or validFrom gives the begin, in hasEnd or validUntil the end; the last one
    counts. Of facts of a contact that are equal in kind and value one with an end goes first, then one with a begin, then one
    that is not historical, then by predicate and source. Statements without notes hold at any time ('').
    """
    key = ["source", "subject", "predicate", "object"]
    bound = F.when(F.col("note").rlike("(hasBeginning|validFrom)$"), "from").when(F.col("note").rlike("(hasEnd|validUntil)$"), "until")
    last = lambda b: F.max(F.when(bound == b, F.struct("ord", "note_value")))["note_value"]
    times = notes.where(bound.isNotNull()).groupBy(*key).agg(last("from").alias("valid_from"), last("until").alias("valid_until"))
    f = facts(s, contacts, "subject", "object").join(times, key, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("valid_from", "valid_until")})
    order = [F.desc(F.col("valid_until") != ""), F.desc(F.col("valid_from") != ""), F.asc("historical"), F.asc("predicate"), F.asc("source"), F.asc("valid_until"), F.asc("valid_from")]
    return best_per_key(f, ["contact", "kind", "value"], order).select("source", "contact", "kind", "value", "predicate", "historical", "valid_from", "valid_until")


def concept_claims(s: DataFrame) -> DataFrame:
    """subject, concept, evidence, role, value of registered predicates; names give a claim a word, others their normalised value."""
    known = vo.terms_table(s.sparkSession).withColumnRenamed("predicate", "known")
    rows = s.join(F.broadcast(known), vo.canonical(F.col("predicate")) == F.col("known"))  # the vocabulary
    named = F.col("concept").isin(*vo.NAME_CONCEPTS)
    how = F.col("normaliser")
    one = F.when(how == "email", email(F.col("object"))).when(how == "phone", phone(F.col("object"))).when(how == "url", url(F.col("object"))).otherwise(F.lower(collapse("object")))
    values = F.when(named, name_tokens(F.regexp_replace("object", "#", " "))).otherwise(F.array(one))
    concept = F.when(named, F.lit("name-token")).otherwise(F.col("concept"))
    return rows.select("subject", concept.alias("concept"), "evidence", "role", F.explode(values).alias("value")).where("value <> ''").distinct()


def card_values(v: Views) -> DataFrame:
    """card, property, value: a property of each customer's address card."""
    props = F.array(*[F.lit(p) for p, _, _ in vo.card_properties()], F.lit("X-OTHER"))
    k = F.col("c_custkey")
    prop = F.element_at(props, (k % (len(vo.card_properties()) + 1) + 1).cast("int"))
    value = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("skype:", "XMPP:", "other:", "")]), (k % 4 + 1).cast("int")), F.lit("handle"), k.cast("string"))
    return v.table("customer").select(k.alias("card"), prop.alias("property"), value.alias("value"))


def card_concepts(cards: DataFrame) -> DataFrame:
    """card, property, concept, service, until: what a property says, an account's service by property or value, and when it closed.
    Other properties are left out."""
    rows = cards.join(F.broadcast(vo.card_table(cards.sparkSession)), "property")  # the vocabulary
    service = F.when(F.col("service") != "", F.col("service")).when(F.col("concept") == "account", vo.service_of(F.col("value"))).otherwise("")
    return rows.select("card", "property", "concept", service.alias("service"), F.coalesce(vo.closed_on(service), F.lit("")).alias("until"))


def timed(v: Views) -> tuple[DataFrame, DataFrame]:
    """(statements, annotations) on the times of orders: plain dates, instants, intervals, and annotations of statements."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    s = k.cast("string")
    later = F.date_format(F.col("o_orderdate") + F.expr("interval 30 days"), "yyyy-MM-dd")
    node, instant, interval = (F.concat(F.lit(p), s) for p in ("order:", "instant:", "interval:"))
    form = lambda n: k % 5 == n
    row = lambda subject, predicate, value, when: F.when(when, F.struct(subject.alias("subject"), F.lit(vo.iri(predicate)).alias("predicate"), value.alias("object")))
    rows = F.array(
        row(node, "schema:startDate", day, form(0)), row(node, "schema:endDate", later, form(0)),
        row(node, "time:hasBeginning", instant, form(1)), row(instant, "time:inXSDDateTime", F.concat(day, F.lit("T10:00:00Z")), form(1)),
        row(node, "time:hasBeginning", day, form(2)), row(node, "time:hasEnd", F.substring(later, 1, 4), form(2)),
        row(node, "own:duringInterval", interval, form(3)), row(interval, "prov:startedAtTime", day, form(3)), row(interval, "prov:endedAtTime", F.lit("some day"), form(3)),
    )
    o = v.table("orders")
    notes = o.where(form(4) | (k % 10 == 0)).select(node.alias("subject"), F.lit(vo.iri("own:validFrom")).alias("predicate"), F.lit("2001-02").alias("object"))
    return o.select(F.inline(F.filter(rows, lambda x: x.isNotNull()))), notes


def normal_time(c) -> F.Column:
    """A date, month, year or UTC time as a UTC time in seconds; '' for anything else."""
    t = F.trim(c)
    full = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01T00:00:00Z"))).when(t.rlike(r"^\d{4}-\d\d$"), F.concat(t, F.lit("-01T00:00:00Z")))
    full = full.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), t)
    return F.when(F.try_to_timestamp(full).isNotNull(), full).otherwise("")


def validity(s: DataFrame, annotations: DataFrame) -> DataFrame:
    """node, valid_from, valid_until ('' open) of every node with a bound.

    Bounds are dates on the node, an instant that the node's beginning or end names or a date in its place, or an interval's ends;
    annotations of a node's statements go before all these. Of several equally good bounds the latest counts.
    """
    p = lambda *names: F.col("predicate").isin(*[vo.iri(n) for n in names])
    begins, ends = p("schema:startDate", "own:validFrom", "time:hasBeginning"), p("schema:endDate", "own:validUntil", "time:hasEnd")
    instants = s.where(p("time:inXSDDateTime")).groupBy(F.col("subject").alias("object")).agg(F.max(normal_time(F.col("object"))).alias("instant"))
    direct = s.where(begins | ends).join(instants, "object", "left")
    at = F.when(p("time:hasBeginning", "time:hasEnd"), F.coalesce(F.nullif("instant", F.lit("")), normal_time(F.col("object")))).otherwise(normal_time(F.col("object")))
    bound = lambda df, time, rank: df.select(F.col("subject").alias("node"), F.when(begins, time).otherwise("").alias("f"), F.when(ends, time).otherwise("").alias("u"), F.lit(rank).alias("rank"))
    edges = s.where(p("prov:startedAtTime", "prov:endedAtTime")).groupBy(F.col("subject").alias("object")).agg(F.max(F.when(p("prov:startedAtTime"), normal_time(F.col("object")))).alias("f"), F.max(F.when(p("prov:endedAtTime"), normal_time(F.col("object")))).alias("u"))
    during = s.where(p("own:duringInterval")).join(edges, "object").select(F.col("subject").alias("node"), F.coalesce("f", F.lit("")).alias("f"), F.coalesce("u", F.lit("")).alias("u"), F.lit(0).alias("rank"))
    notes = annotations.where(p("own:validFrom", "own:validUntil", "time:hasEnd"))
    every = bound(direct, at, 0).unionByName(during).unionByName(bound(notes, normal_time(F.col("object")), 1))
    best = lambda c: F.coalesce(F.max(F.when(F.col(c) != "", F.struct("rank", c)))[c], F.lit(""))
    return every.groupBy("node").agg(best("f").alias("valid_from"), best("u").alias("valid_until")).where("valid_from <> '' or valid_until <> ''")


def alias_owners(s: DataFrame) -> DataFrame:
    """alias, contact, state: each own alias goes to the first contact that claims it; later claims by others are in conflict."""
    from lodestone.functions.text import alias_slug

    claims = s.where(F.col("predicate").isin(vo.iri("own:contactAlias"), vo.iri("schema:worksFor"))).select(alias_slug("object").alias("alias"), F.col("subject").alias("contact")).where("alias <> ''").distinct()
    first = best_per_key(claims, ["alias"], [F.asc("contact")]).withColumnRenamed("contact", "owner")
    return claims.join(first, "alias").select("alias", "contact", F.when(F.col("contact") == F.col("owner"), "active").otherwise("conflict").alias("state"))


def emitted(v: Views) -> DataFrame:
    """subject, predicate, object: names, addresses and coordinates of suppliers' cards as canonical statements on nodes of their own."""
    k = F.col("s_suppkey")
    me = F.concat(F.lit("contact:s"), k.cast("string"))
    name, place = F.concat(F.lit("urn:name:s"), k.cast("string")), F.when(k % 3 == 0, F.concat_ws(";", F.lit(""), F.lit(""), F.concat(F.lit("Street "), k.cast("string")), F.lit("Town"), F.lit(" "), F.lpad(k.cast("string"), 5, "0"), F.lit("XX"))).otherwise(F.concat(F.lit("Only Street "), k.cast("string")))
    geo = F.when(k % 2 == 0, F.concat(F.lit("geo:"), (k % 90).cast("string"), F.lit(".5,-"), (k % 180).cast("string"))).otherwise("north;south")
    parts = v.table("supplier").select(me.alias("me"), name.alias("name"), st.name_parts(F.concat_ws(";", F.col("s_name"), F.lit("Given,Two"), F.lit(" M "))).alias("n"), place.alias("place"), st.address(place).alias("a"), st.coordinates(geo).alias("g"))
    addr = F.concat(F.lit("urn:addr:"), F.substring(F.sha2(F.lower("place"), 256), 1, 16))
    spot = F.concat(F.lit("urn:place:"), F.substring(F.sha2(F.concat_ws(",", "g.latitude", "g.longitude"), 256), 1, 16))
    row = lambda subject, predicate, value: F.when(F.coalesce(value, F.lit("")) != "", F.struct(subject.alias("subject"), F.lit(vo.iri(predicate)).alias("predicate"), value.alias("object")))
    full = F.array_join(F.filter(F.array("n.prefix", "n.given", "n.middle", "n.family", "n.suffix"), lambda x: x != ""), " ")
    terms = dict(zip(st.ADDRESS, ("own:postOfficeBox", "own:extendedAddress", "own:streetAddress", "own:addressLocality", "own:addressRegion", "own:postalCode", "own:countryCode")))
    rows = [row(F.col("me"), "own:hasName", F.col("name")), row(F.col("name"), "own:fullName", full), row(F.col("me"), "own:hasContactPoint", addr)]
    rows += [row(addr, term, F.col(f"a.{field}")) for field, term in terms.items()]
    rows += [row(F.col("me"), "own:locatedAt", F.when(F.col("g").isNotNull(), spot)), row(spot, "own:latitude", F.col("g.latitude")), row(spot, "own:longitude", F.col("g.longitude"))]
    return parts.select(F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull()))).distinct()
