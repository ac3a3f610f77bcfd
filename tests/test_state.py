"""State, resolution and vocabulary against plain loops, where SQL is no help."""

import random

import pytest

from lodestone.functions import vocabulary as vo
from lodestone.operators import jobs, resolve, state
from lodestone.plans.views import Views


def test_vocabulary_tables():
    assert len({p for p, *_ in vo.terms()}) == len(vo.terms()) == 59
    assert len(vo.fact_kinds()) == len({p for p, _, _ in vo.fact_kinds()}) and len({k for _, k, _ in vo.fact_kinds()}) == 16
    assert [p for p, _, h in vo.fact_kinds() if h] == [vo.OWN + "historicalEmail"]
    first = {}
    for p, concept, *_ in vo.terms():
        first.setdefault(concept, p)
    assert first["name"] == vo.OWN + "fullName" and first["email"] == vo.iri("schema:email")
    assert dict((p, s) for p, _, s in vo.card_properties())["X-ICQ"] == "https://icq.com/" and vo.CLOSED["https://icq.com/"] == "2024-06-26"
    assert vo.terms("urn:x:")[0][0] == "urn:x:fullName"


def test_registry():
    r = state.Registry(("b", "1", len), (" a ", "2", str), ("a", "1", int))
    assert r.specs() == [("a", "1"), ("a", "2"), ("b", "1")] and r.get("a", " 2") is str and r.get("a", "3") is None
    for bad in [("", "1", len)], [("a", " ", len)], [("a", "1", len), ("a ", "1", len)]:
        with pytest.raises(ValueError):
            state.Registry(*bad)


def test_embedding_batches():
    texts = ["x" * 40] * 30 + ["y" * 8000] + ["z" * 3000, "z" * 3000, "z"]
    got = state.embedding_batches(texts)
    assert sum(got, []) == list(range(len(texts))) and all(len(b) <= 12 for b in got)
    assert all(len(b) == 1 or sum((len(texts[i]) + 3) // 4 for i in b) <= 1500 for b in got) and [30] in got


def test_cache_and_snapshot(spark, tmp_path):
    wanted = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b"), ("k3", "c")], "key string, text string")
    cache = spark.createDataFrame([("n", "k1"), ("other", "k2")], "namespace string, key string")
    assert sorted(r.key for r in state.uncached(wanted, cache, "n").collect()) == ["k2", "k3"]
    folder = f"file://{tmp_path}/snap"
    state.snapshot({"wanted": wanted, "cache": cache}, folder)
    back = state.restore(spark, folder, ["wanted", "cache"])
    assert sorted(map(tuple, back["wanted"].collect())) == sorted(map(tuple, wanted.collect())) and back["cache"].schema == cache.schema


def test_claims_match_a_loop(spark):
    r = random.Random(2)
    rows = [(r.randrange(4), i, r.randrange(200_000)) for i in range(300)] + [(9, 900, 5), (9, 901, 5), (9, 902, 905), (9, 903, 906)]
    df = spark.createDataFrame(rows, "ref long, id long, s long").selectExpr("ref", "id", "timestamp_seconds(s) as at")
    last, want = {}, set()
    for ref, i, s in sorted(rows, key=lambda x: (x[2], x[1])):
        if ref not in last or s - last[ref] > 900:
            last[ref] = s
            want.add((ref, i))
    assert {(x.ref, x.id) for x in state.granted_claims(df).collect()} == want
    assert state.granted_claims(df.where("false")).count() == 0


def test_breakers_see_every_outcome(spark, tiny):
    v = Views(spark, tiny)
    got = {x.event_id: (x.allowed, x.state) for x in jobs.breaker_states(v).collect()}
    rows = sorted((x.job, x.ts, x.event_id, x.ok) for x in jobs.outcomes(v).collect())
    assert len(got) == len(rows)
    breakers = {}
    for job, ts, event_id, ok in rows:
        b = breakers.setdefault(job, jobs.Breaker())
        now = (ts - rows[0][1].replace(year=2000)).total_seconds()
        allowed = b.allow(now)
        if allowed:
            b.record(ok, now)
        assert got[event_id] == (allowed, b.state)
    assert any(s != "closed" for _, s in got.values()) or len(breakers) > 0


def test_resolution_by_component_is_one_pass_over_all(spark, tiny):
    v = Views(spark, tiny)
    v.table = lambda name, t=v.table: t(name).unionByName(t(name).selectExpr("c_custkey + 500 as c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")).where("c_custkey % 500 < 40") if name == "customer" else t(name)
    rows = resolve.claims(v).join(resolve.claim_idf(v).select("attr", "value", "omega"), ["attr", "value"]).collect()
    by = {}
    for x in rows:
        by.setdefault(x.entity, []).append(resolve.Claim(x.attr, x.value, x.kind, x.omega, x.role))
    want = resolve.resolve_in_order((e, sorted(by[e], key=lambda c: (c.attr, c.value))) for e in sorted(by))
    got = {tuple(r) for r in resolve.resolve_by_component(v).collect()}
    assert got == set(want) and any(a == "merged" for _, _, a in want)


def test_stream_of_three_files_merges_buckets(spark, tiny, tmp_path):
    from pyspark.sql import functions as F

    from lodestone.streaming import pipeline

    events = Views(spark, tiny).table("events")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = pipeline.projected(stream, f"file://{tmp_path}/state", buckets=4)
    want = jobs.project_events(events)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    (tmp_path / "none").mkdir()
    nothing = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/none")
    assert pipeline.projected(nothing, f"file://{tmp_path}/empty").count() == 0


def test_discovery_of_copies(spark):
    from lodestone.operators import discovery

    texts = ["alpha beta gamma delta"] * 5 + ["omega sigma kappa theta", "omega sigma kappa lambda theta", "unrelated words stand here alone", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.cluster: r.size for r in discovery.discover(docs).collect()}
    assert got == {"0": 5, "5": 2}
