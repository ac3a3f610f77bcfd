"""Repair of resolved entities by rounds: candidates by neighbourhood and identifiers, signed scores, constrained linkage, folded claims.

A round folds the claims of entities that are one, weighs and scores them again, and links what now belongs together. Linkage takes
the strongest edges first and never joins two clusters with a pair that must not be linked. Clusters that are each other's strongest
open edge are joined at once: no other edge of theirs would have come before it, so the result is that of one pass in order.

Pairs are scored by classes of entities that score alike. A component of open edges without a pair that must not be linked is one
cluster, whatever their order; only the entities of other components are linked edge by edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.neighbours import identity_classes, near_pairs
from lodestone.operators.resolve import GATE, ROUNDS, VETO, claims, class_pairs, classes, idf_of, score_both, score_pairs, weighted_classes
from lodestone.plans.fixpoint import written
from lodestone.plans.labels import smallest_reachable
from lodestone.plans.views import Views

IDENTIFIERS = ("account", "email", "phone", "url")
#: Neighbours of an entity that are candidates, and the records of an identifier that are all paired.
NEIGHBOURS, GROUP = 24, 64


def identifier_pairs(c: DataFrame, seed: int = 0, group: int = GROUP) -> DataFrame:
    """a, b: entities with an identifier in common: all pairs where it has up to `group`; of more, all pairs within parts that the
    hash of a round deals, and every entity with the smallest. Bounded candidates for `repaired`'s `pairs`; its own are all pairs, by classes."""
    held = c.where(F.col("attr").isin(*IDENTIFIERS)).select("entity", "attr", "value").distinct()
    sizes = held.groupBy("attr", "value").agg(F.count("*").alias("n"), F.min("entity").alias("least")).where("n > 1")
    sizes = written(sizes, "identifiers")
    parts = F.ceil(F.col("n") / F.lit(group))
    dealt = written(held.join(sizes, ["attr", "value"]).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "entity"), parts)), "identifier-parts")
    star = dealt.where(F.col("n") > group).select(F.col("least").alias("a"), F.col("entity").alias("b"))
    left, right = (dealt.select("attr", "value", "part", F.col("entity").alias(x)) for x in ("a", "b"))
    return left.join(right, ["attr", "value", "part"]).select("a", "b").unionByName(star).where("a < b").distinct()


def weighed(c: DataFrame, weights: DataFrame) -> DataFrame:
    """entity, claims, class, n: the classes of entities with equal claims, which have their weights."""
    return identity_classes(c.join(weights.select("attr", "value", "omega"), ["attr", "value"]))


def copies(members: DataFrame) -> DataFrame:
    """a, b: the smallest entity of each vector and each other one that has it."""
    return members.where("entity != rep").select(F.col("rep").alias("a"), F.col("entity").alias("b"))


def identifier_classes(alike: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity, class of the records that share an identifier, with equal ones of these a class; and a, b (a <= b), pairs of classes each
    record of which shares one with each of the other: all of them, however many have it. `alike` are classes of equal claims."""
    held = alike.where("entity = class").select("class", "n", F.explode(F.array_distinct(F.transform("claims", lambda x: F.struct(x["attr"].alias("attr"), x["value"].alias("value"))))).alias("x"))
    held = written(held.select("class", "n", "x.*").where(F.col("attr").isin(*IDENTIFIERS)), "identifiers-held")
    several = held.groupBy("attr", "value").agg(F.sum("n").alias("df")).where("df > 1").drop("df")
    sets = held.join(several, ["attr", "value"]).groupBy(F.col("class").alias("entity"), "n").agg(F.sort_array(F.collect_list(F.struct("attr", "value"))).alias("claims"))
    found = written(classes(sets), "identifier-classes")
    members = alike.select("entity", F.col("class").alias("of")).join(found.select(F.col("entity").alias("of"), "class"), "of").select("entity", "class")
    return members, class_pairs(found, IDENTIFIERS).select("a", "b")


def constrained_linkage(edges: DataFrame, cannot: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """id, cluster (its smallest id) of the nodes of edges (a, b, weight), none of whose clusters holds a pair (a, b) of cannot.

    Each step keeps the strongest edge of two clusters, drops those that a forbidden pair parts, and joins the clusters whose strongest
    edge is the same. What remains are clusters, so steps get smaller; no component meets in one task. Of `values` (id, attr, value,
    omega), two that differ part their clusters if one weighs VETO: this is seen on the values of clusters, without a list of pairs.
    """
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("cluster", F.col("id")), "linkage")
    key = F.struct((-F.col("weight")).alias("w"), F.col("a").alias("a"), F.col("b").alias("b"))
    open_ = edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), key.alias("e")).where("x != y")
    bad = cannot.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    merged = None
    while True:
        if merged is not None:
            open_, bad = (_moved(df, merged) for df in (open_, bad))
            bad = bad.distinct()
        bad = written(bad, "linkage-bad")
        open_ = open_.groupBy("x", "y").agg(F.min("e").alias("e")).join(bad, ["x", "y"], "left_anti")
        if values is not None:
            open_ = written(open_, "linkage-near")
            open_ = open_.join(_parted(open_, values.join(labels, "id").groupBy("cluster", "attr").agg(F.collect_set(F.struct("value", "omega")).alias("held"))), ["x", "y"], "left_anti")
        open_ = written(open_, "linkage-open")
        best = open_.select(F.explode(F.array("x", "y")).alias("c"), "e").groupBy("c").agg(F.min("e").alias("e"))
        best = written(best, "linkage-best")
        of = lambda end: best.select(F.col("c").alias(end), "e")
        merged = written(open_.join(of("x"), ["x", "e"], "left_semi").join(of("y"), ["y", "e"], "left_semi").select(F.col("y").alias("old"), F.col("x").alias("new")), "linkage-merged")
        if not merged.limit(1).count():
            return labels
        labels = written(labels.join(merged, F.col("cluster") == F.col("old"), "left").select("id", F.coalesce("new", "cluster").alias("cluster")), "linkage")


def _moved(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """Pairs (x, y) between the clusters as they are now, without those inside one."""
    for end in ("x", "y"):
        pairs = pairs.join(merged.withColumnRenamed("old", end), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    rest = [c for c in pairs.columns if c not in ("x", "y")]
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), *rest).where("x != y")


def _parted(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """x, y: the pairs of clusters that hold (cluster, attr, held) different values of an attribute, one of which weighs VETO."""
    for end in ("x", "y"):
        pairs = pairs.join(held.select(F.col("cluster").alias(end), "attr", F.col("held").alias(f"{end}_held")), [end] if end == "x" else [end, "attr"])
    differ = lambda u, v: (u["value"] != v["value"]) & (F.greatest(u["omega"], v["omega"]) >= VETO)
    return pairs.where(F.exists("x_held", lambda u: F.exists("y_held", lambda v: differ(u, v)))).select("x", "y").distinct()


def folded(c: DataFrame, labels: DataFrame) -> DataFrame:
    """Claims with their entities' clusters; equal claims of one are one."""
    moved = c.join(labels.withColumnRenamed("id", "entity"), "entity", "left").withColumn("entity", F.coalesce("cluster", "entity"))
    return moved.groupBy("entity", "attr", "value").agg(F.min("kind").alias("kind"), F.min("role").alias("role"))


def open_entities(c: DataFrame, weights: DataFrame) -> DataFrame:
    """entity: those that may have an open edge to one with which they share no identifier.

    Two that have different values of a functional attribute must not be linked if one of them weighs VETO. Where all entities have such
    an identifier, one whose own weighs as much has no open edge but to those that share it.
    """
    ids = c.where((F.col("kind") == "functional") & F.col("attr").isin(*IDENTIFIERS)).join(weights.select("attr", "value", "omega"), ["attr", "value"])
    n = c.agg(F.count_distinct("entity").alias("all"))
    whole = ids.groupBy("attr").agg(F.count_distinct("entity").alias("n")).crossJoin(F.broadcast(n)).where(F.col("n") == F.col("all")).select("attr")  # a row an attribute
    strong = ids.where(F.col("omega") >= VETO).join(F.broadcast(whole), "attr", "left_semi").select("entity").distinct()
    return c.select("entity").distinct().join(strong, "entity", "left_anti")


def scored_candidates(c: DataFrame, weights: DataFrame, named: DataFrame, tau: float = 0.85, k: int = NEIGHBOURS) -> DataFrame:
    """a, b (a <= b), score, veto, back: pairs of classes (entity, claims, class, n) whose entities are all candidates, with the score of
    each of class a that comes in to each of class b, and the other way round.

    Candidates share an identifier, have equal claims, or are near: one identity vector is among the k nearest of the other. Near ones
    are only searched among entities that can be linked to them; leaving others out makes no rank worse.
    """
    pairs = class_pairs(named, IDENTIFIERS).select("a", "b").unionByName(named.where("entity = class and n > 1").select(F.col("class").alias("a"), F.col("class").alias("b")))
    loose = written(open_entities(c, weights), "open-entities")
    if loose.limit(1).count():
        near, members = near_pairs(weighed(c.join(loose, "entity", "left_semi"), weights), k)
        of = lambda end: named.select(F.col("entity").alias(end), F.col("class").alias(f"{end}_class"))
        found = near.unionByName(copies(members)).join(of("a"), "a").join(of("b"), "b")
        sizes = found.join(named.where("entity = class").select(F.col("class").alias("a_class"), "n"), "a_class").where("a_class <> b_class or n > 1")
        pairs = pairs.unionByName(sizes.select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b")))
    return score_both(pairs.distinct(), named.where("entity = class").select("entity", "claims"), tau)


def linked_classes(c: DataFrame, weights: DataFrame, threshold: float = GATE, tau: float = 0.85) -> DataFrame:
    """id, cluster of the entities of claims that a round links: those of constrained linkage over all candidates, where all pairs with
    different values of a functional attribute, one of which weighs VETO, are parted."""
    named = written(weighted_classes(c, weights), "repair-classes")
    ends = named.groupBy("class").agg(F.max("entity").alias("last"))
    scored = scored_candidates(c, weights, named, tau).join(ends.withColumnRenamed("class", "a"), "a")
    scored = scored.withColumn("turns", (F.col("a") != F.col("b")) & (F.col("last") > F.col("b")))  # some entity of a comes after one of b
    good, back = ((F.col(x) >= threshold) & ~F.col("veto") for x in ("score", "back"))
    scored = written(scored.select("a", "b", "score", "back", "veto", good.alias("good"), (F.col("turns") & back).alias("back_good"), (F.col("turns") & (good != back)).alias("mixed")), "repair-scores")
    label = smallest_reachable(scored.where("good or back_good").select("a", "b"))
    of = lambda end: label.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    inside = written(scored.where("good or back_good or veto or mixed").join(of("a"), "a").join(of("b"), "b").where("ca = cb").withColumnRenamed("ca", "component").drop("cb"), "repair-inside")
    held = named.join(label.withColumnRenamed("id", "class"), "class").select("component", "entity", F.explode("claims").alias("x"))
    values = held.where("x.kind = 'functional'").groupBy("component", "x.attr").agg(F.count_distinct("x.value").alias("known"), F.count(F.when(F.col("x.value").isNull(), 1)).alias("own"), F.max("x.omega").alias("omega"))
    parted = inside.where("veto or mixed").select("component").unionByName(values.where((F.col("known") + F.col("own") > 1) & (F.col("omega") >= VETO)).select("component"))
    parted = written(parted.distinct(), "repair-parted")
    members = named.select("entity", "class").join(label.withColumnRenamed("id", "class"), "class")
    whole = members.join(parted, "component", "left_anti").select(F.col("entity").alias("id"), F.col("component").alias("cluster"))
    if not parted.limit(1).count():
        return whole
    members = written(members.join(parted, "component", "left_semi").select("entity", "class"), "repair-members")
    each = lambda end, name: members.select(F.col("class").alias(end), F.col("entity").alias(name))
    pairs = inside.join(parted, "component", "left_semi").join(each("a", "x"), "a").join(each("b", "y"), "b").where("a <> b or x < y")
    pairs = written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("score")).otherwise(F.col("back")).alias("weight"), "veto"), "repair-edges")
    functional = c.where("kind = 'functional'").join(weights.select("attr", "value", "omega"), ["attr", "value"]).select(F.col("entity").alias("id"), "attr", "value", "omega")
    functional = written(functional.join(members.select(F.col("entity").alias("id")), "id", "left_semi"), "repair-values")
    return whole.unionByName(constrained_linkage(pairs.where((F.col("weight") >= threshold) & ~F.col("veto")).select("a", "b", "weight"), pairs.where("veto").select("a", "b"), functional))


def repaired(c: DataFrame, threshold: float = GATE, tau: float = 0.85, rounds: int = ROUNDS, pairs: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """entity, cluster of all entities of the claims (entity, attr, value, kind, role): rounds until one joins nothing, `rounds` at most.

    Candidates are found and scored by classes, unless `pairs` names those of a round from its claims, their weights and the round's
    number. An edge is open from threshold on; a veto parts its pair. A cluster has the name of its smallest entity. An empty table gives
    an empty one.
    """
    names = written(c.select("entity").distinct().withColumn("cluster", F.col("entity")), "repair")
    now = written(folded(c, names.withColumnRenamed("entity", "id")), "repair-claims")
    for turn in range(rounds):
        weights = written(idf_of(now), "repair-weights")
        if pairs is None:
            labels = linked_classes(now, weights, threshold, tau)
        else:
            scored = written(score_pairs(pairs(now, weights, turn).select("a", "b"), now, weights, tau), "repair-scores")
            labels = constrained_linkage(scored.where((F.col("score") >= threshold) & ~F.col("veto")).select("a", "b", F.col("score").alias("weight")), scored.where("veto").select("a", "b"))
        labels = written(labels.where("id != cluster"), "repair-labels")
        if not labels.limit(1).count():
            break
        now = written(folded(now, labels), "repair-claims")
        names = written(names.join(labels.withColumnRenamed("cluster", "to"), F.col("cluster") == F.col("id"), "left").select("entity", F.coalesce("to", "cluster").alias("cluster")), "repair")
    return names


def all_candidates(v: Views, k: int = NEIGHBOURS) -> DataFrame:
    """part, a, b: all pairs of records to score, by classes.

    A row of part `member` puts record a into class b of records that share the same identifiers; `shared` says that each record of class a
    shares one with each of class b (other than itself where a = b). A row of part `copy` says that record a has the identity vector of
    record b, the smallest with it; `near` that b is among the k nearest of a or a of b, which holds for their copies too.
    """
    c = claims(v)
    alike = written(weighed(c, idf_of(c)), "alike")
    near, vectors = near_pairs(alike, k)
    members, shared = identifier_classes(alike)
    same = copies(vectors).select(F.col("b").alias("a"), F.col("a").alias("b"))
    out = None
    for part, rows in (("member", members.select(F.col("entity").alias("a"), F.col("class").alias("b"))), ("shared", shared), ("copy", same), ("near", near)):
        rows = rows.select(F.lit(part).alias("part"), "a", "b")
        out = rows if out is None else out.unionByName(rows)
    return out


def all_repaired(v: Views) -> DataFrame:
    return repaired(claims(v))
