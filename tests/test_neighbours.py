"""Neighbours of more rows than a cell holds, and candidates of identifiers that many records have."""

import itertools

import numpy as np
from pyspark.sql import functions as F
from test_classes import people

from lodestone.operators import neighbours, repair, resolve


def true_share(df, k, found):
    """The share of the true k nearest rows that were found, or others as near."""
    held = df.collect()
    names, x = [r.entity for r in held], np.array([r.vec for r in held])
    cos = np.round(x @ x.T, 6)
    np.fill_diagonal(cos, -2)
    best = -np.sort(-cos, axis=1)[:, :k]
    at = {n: i for i, n in enumerate(names)}
    got = np.full_like(best, -2)
    for r in found.groupBy("a").agg(F.sort_array(F.collect_list("cosine"), False).alias("c")).collect():
        got[at[r.a], : len(r.c)] = r.c
    return (got >= best - 2e-6).mean()


def test_recall_of_rows_about_a_common_middle(spark):
    n = 4000
    rows = [(f"e{i:05d}", attr, value, w) for i in range(n) for attr, value, w in (("account", f"own-{37 * i}", 12.0), ("email", f"p{37 * i % 500}@mail.example", 4.0), ("phone", f"555{37 * i % 700:04d}", 4.0))]
    vectors = neighbours.identity_vectors(spark.createDataFrame(rows, "entity string, attr string, value string, omega double")).cache()
    found = neighbours.nearest(vectors, 24).cache()
    assert found.groupBy("a").count().agg(F.max("count")).first()[0] <= 24
    assert found.count() == found.select("a", "b").distinct().count()
    assert true_share(vectors, 24, found) >= 0.9


def test_large_cells_are_compared_whole_by_blocks(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"e{i:03d}", [float(y) for y in v]) for i, v in enumerate(x)], "entity string, vec array<float>")
    found = [neighbours.nearest(df, 5, floor=-1.0, most=m) for m in (20, 4096)]
    assert true_share(df, 5, found[0]) == 1
    pairs = [{(p.a, p.b) for p in f.collect()} for f in found]
    assert len(pairs[0] & pairs[1]) >= 0.999 * 1500 and len(pairs[0]) == 1500


def test_vectors_do_not_depend_on_the_order_of_claims(spark):
    rows = [(e, f"a{i}", f"value{i}", 0.1 + i / 7) for e, order in (("x", 1), ("y", -1)) for i in range(30)[::order]]
    x, y = neighbours.identity_vectors(spark.createDataFrame(rows, "entity string, attr string, value string, omega double").coalesce(1)).collect()
    assert x.vec == y.vec


def test_candidates_hold_every_pair_of_an_identifier(spark):
    v = people(spark, persons=2, copies=150)
    rows = repair.all_candidates(v, 3).collect()
    of = {}
    for r in rows:
        if r.part == "member":
            of.setdefault(r.b, set()).add(r.a)
    got = {tuple(sorted(p)) for r in rows if r.part == "shared" for p in itertools.product(of[r.a], of[r.b]) if p[0] != p[1]}
    c = resolve.claims(v).where(F.col("attr").isin(*repair.IDENTIFIERS)).select("entity", "attr", "value")
    wanted = c.withColumnRenamed("entity", "a").join(c.withColumnRenamed("entity", "b"), ["attr", "value"]).where("a < b").select("a", "b").distinct()
    assert got == {(r.a, r.b) for r in wanted.collect()} and len(got) >= 2 * 150 * 149 / 2
    names = {r.entity for r in c.collect()}
    copies = {r.a: r.b for r in rows if r.part == "copy"}
    near = {x for r in rows if r.part == "near" for x in (r.a, r.b)}
    assert names == copies.keys() | near and not copies.keys() & near and set(copies.values()) <= near
