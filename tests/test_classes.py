"""Resolution on classes of records against every pair of records and the serial rules."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import repair, resolve
from lodestone.plans.views import Views

CLAIMS = "entity string, attr string, value string, kind string, role string"


class People(Views):
    """Customers with the given keys and segments."""

    def __init__(self, spark, rows):
        super().__init__(spark, "")
        self.rows = spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").cache()

    def table(self, name):
        assert name == "customer"
        return self.rows


def people(spark, persons=6, copies=40):
    keys = [p + 500 * k for p in range(1, persons + 1) for k in range(copies)]
    return People(spark, [(k, f"segment{k // 500 % 2}") for k in keys])


def every_pair(spark, v):
    c = resolve.claims(v)
    held = c.where(F.col("attr").isin("account", "email", "phone")).select("entity", "attr", "value")
    pairs = held.withColumnRenamed("entity", "a").join(held.withColumnRenamed("entity", "b"), ["attr", "value"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("attr")), ",").alias("shared"))


def expanded(rows, value):
    """(a, b) -> value of all pairs of records that rows of classes stand for."""
    of = {}
    for r in rows:
        if r.part == "member":
            of.setdefault(r.b, []).append(r.a)
    out = {}
    for r in rows:
        if r.part == "pair":
            for x, y in itertools.product(of[r.a], of[r.b]):
                if x != y:
                    key = tuple(sorted((x, y)))
                    assert out.setdefault(key, value(r)) == value(r)
    return out


def test_blocking_of_classes_is_that_of_records(spark):
    v = people(spark)
    rows = resolve.blocking(v).collect()
    assert expanded(rows, lambda r: r.shared) == {(r.a, r.b): r.shared for r in every_pair(spark, v).collect()}
    assert len(rows) < 1000  # every pair of a person's 40 records meets: 4,680 and more


def test_scores_of_classes_are_those_of_records(spark):
    v = people(spark, 5, 40)
    wanted = resolve.score_pairs(every_pair(spark, v), resolve.claims(v), resolve.claim_idf(v)).collect()
    rows = resolve.scored_edges(v).collect()
    assert expanded(rows, lambda r: (r.score, r.veto)) == {(r.a, r.b): (r.score, r.veto) for r in wanted}
    assert len({r.veto for r in wanted}) == 2 and sum(r.part == "pair" for r in rows) < len(wanted) / 2


def test_scores_are_counted_once_a_pattern(monkeypatch):
    calls, score = [], resolve.id_diff
    monkeypatch.setattr(resolve, "id_diff", lambda *a, **k: calls.append(1) or score(*a, **k))
    scorer, r = resolve.PairScores(0.85), random.Random(2)
    kinds = {"email": "set", "account": "functional", "name": "name", "affiliation": "contextual"}
    one = lambda: [{"attr": a, "value": r.choice(["x", "xy", "y", "yz"]), "kind": k, "omega": r.choice([0.5, 4.5]), "role": ""} for a, k in sorted(kinds.items()) if r.random() < 0.8]
    for _ in range(3000):
        a, b = one(), one() + ([{"attr": "email", "value": "z", "kind": "set", "omega": 1.0, "role": ""}] if r.random() < 0.1 else [])
        s = score(*[[resolve.Claim(**{("weight" if k == "omega" else k): v for k, v in c.items()}) for c in side] for side in (a, b)], 0.85)
        assert scorer.score(json.dumps(a), json.dumps(b)) == (round(s.score, 6), s.veto)
    assert len(calls) < 2800
    del calls[:]
    for i in range(500):
        scorer.score(*[json.dumps([{"attr": "email", "value": f"{side}{i}", "kind": "set", "omega": 2.5, "role": ""}]) for side in "ab"])
    assert len(calls) == 1


def test_clusters_of_classes_are_those_of_records(spark):
    v = people(spark, 5, 12)
    scored = resolve.score_pairs(every_pair(spark, v), resolve.claims(v), resolve.claim_idf(v)).collect()
    wanted = resolve.repair([(r.a, r.b, r.score) for r in scored if not r.veto], [(r.a, r.b) for r in scored if r.veto])
    assert {r.entity: r.cluster for r in resolve.clusters(v).collect()} == wanted and len(set(wanted.values())) == 5


def test_components_that_hold_a_veto_are_linked_in_order(spark, monkeypatch):
    r = random.Random(3)
    members = {f"e{100 + i}": f"e{100 + i - i % 3}" for i in range(90)}  # classes of three
    reps = sorted(set(members.values()))
    pairs = [(a, b, round(r.uniform(0.5, 1.5), 1), r.random() < 0.15) for a, b in itertools.combinations_with_replacement(reps, 2) if r.random() < 0.07 or (a == b and r.random() < 0.8)]
    of = {c: [e for e, k in members.items() if k == c] for c in reps}
    each = [(min(x, y), max(x, y), w, veto) for a, b, w, veto in pairs for x, y in (itertools.combinations(of[a], 2) if a == b else itertools.product(of[a], of[b]))]
    wanted = resolve.repair([e[:3] for e in each if not e[3]], [e[:2] for e in each if e[3]])
    tables = spark.createDataFrame(list(members.items()), "entity string, class string"), spark.createDataFrame(pairs, "a string, b string, score double, veto boolean")
    monkeypatch.setattr(resolve, "scored_classes", lambda v: tables)
    assert {x.entity: x.cluster for x in resolve.clusters(None).collect()} == wanted


def claim_rows(seed, records=150, people=12):
    r = random.Random(seed)
    rows = []
    for i in range(records):
        p, e = r.randrange(people), f"e{i}"
        for attr, value, kind, role, share in (
            ("email", f"p{p}@mail.example", "set", "locator", 0.9), ("email", f"q{r.randrange(4)}@mail.example", "set", "locator", 0.2), ("email", f"only{i}@mail.example", "set", "locator", 0.2),
            ("phone", f"555{p % 5}", "set", "locator", 0.6), ("account", f"acct-{p}" if r.random() < 0.7 else f"own-{i}", "functional", "account", 0.5),
            ("affiliation", f"org{p % 3}", "contextual", "", 0.8), ("name", f"given{p}" if r.random() < 0.9 else f"g{i}", "name", "", 0.9), ("name", "g", "name", "", 0.1),
        ):
            if r.random() < share:
                rows.append((e, attr, value, kind, role))
    return rows


@pytest.mark.parametrize("seed,gate", [(1, resolve.GATE), (2, resolve.GATE), (3, 2.5), (4, 0.3), (5, 4.0)])
def test_resolving_kinds_of_entities_is_resolving_all(spark, seed, gate):
    c = spark.createDataFrame(claim_rows(seed), CLAIMS)
    weights = resolve.idf_of(c)
    omega = {(r.attr, r.value): r.omega for r in weights.collect()}
    sets = {}
    for e, *claim in sorted(claim_rows(seed), key=lambda x: (x[0], x[1], x[2])):
        sets.setdefault(e, []).append(resolve.Claim(*claim[:3], omega[claim[0], claim[1]], claim[3]))
    wanted = resolve.resolve_in_order(sorted(sets.items()), gate)
    got = resolve.resolved(resolve.weighted_classes(c, weights), gate).collect()
    assert {tuple(r) for r in got} == set(wanted) and len(got) == len(sets)
    assert {a for _, _, a in wanted} == {"created", "merged", "noop"}


def test_crowds_are_resolved_by_kinds(spark, monkeypatch):
    """Scores that a crowd of records with accounts of their own takes: as many as there are kinds of them, not pairs."""
    calls = []
    score = resolve.id_diff
    monkeypatch.setattr(resolve, "id_diff", lambda *a, **k: calls.append(1) or score(*a, **k))
    state = resolve.Resolver()
    claims = [{"attr": "email", "value": "p@mail.example", "kind": "set", "omega": 1.0, "role": "locator"}, {"attr": "account", "value": None, "kind": "functional", "omega": 9.0, "role": "account"}]
    got = [state.see(f"e{i:05d}", "e00000", lambda: claims) for i in range(5000)]
    assert all(a == "created" for _, _, a in got) and len(calls) == 1


def test_tables_of_short_rows_are_spread(spark, tiny):
    class Small(Views):
        def spread(self, name, key):
            return super().spread(name, key, 40)

    assert Views(spark, tiny).spread("customer", "c_custkey").rdd.getNumPartitions() == 1
    v = Small(spark, tiny)
    customers = v.table("customer").count()
    assert v.spread("customer", "c_custkey").rdd.getNumPartitions() == -(-customers // 40) > 1
    assert sorted(map(tuple, v.facts().collect())) == sorted(map(tuple, Views(spark, tiny).facts().collect()))
    assert resolve.claims(v).rdd.getNumPartitions() > 1
