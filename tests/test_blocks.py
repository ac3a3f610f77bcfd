"""Blocks of vectors against all pairs."""

import random

import numpy as np
import pytest

from lodestone.operators import discovery, vectors
from lodestone.plans.labels import smallest_reachable
from lodestone.plans.views import Views


@pytest.mark.parametrize("group", [8192, 60])
def test_forest_of_blocks_has_the_components_of_all_pairs(spark, monkeypatch, group):
    r = random.Random(5)
    rows = []
    for i in range(200):
        words = [f"w{r.randrange(40)} " for _ in range(r.randrange(1, 7))]
        rows.append((f"d{i:03d}", "".join(words)))
    v = discovery.tfidf(spark.createDataFrame(rows + [("none", "")], "id string, text string"))
    wanted = smallest_reachable(discovery.cosine_pairs(v, 0.7).select("a", "b")).collect()
    monkeypatch.setattr(discovery, "GROUP", group)
    links = discovery.eps_forest(v, 0.7)
    assert set(smallest_reachable(links).collect()) == set(wanted)
    assert 10 < len({x.component for x in wanted}) and links.count() < (200 if group > 200 else 200 * 7)


def test_no_vectors_have_no_clusters(spark):
    assert discovery.discover(spark.createDataFrame([("a", ""), ("b", None)], "id string, text string")).count() == 0


def test_nearest_of_many_in_a_facet(spark, monkeypatch):
    """Queries and rows of several blocks, one facet, with copies; rows travel in blocks, not with a list of queries each."""
    monkeypatch.setattr(vectors, "BLOCK", 128)
    r = np.random.default_rng(1)
    x = r.standard_normal((900, 8)).astype(np.float32)
    x[450:500] = x[400:450]
    rows = [(i, 1 if i % 9 else None, [float(y) for y in x[i]] if i != 77 else None) for i in range(900)]

    class Held(Views):
        def table(self, name):
            return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")

    wanted = {}
    for q in range(0, 900, 50):
        if q % 9:
            c = [(-round(float(np.dot(x[q].astype(float), x[i].astype(float)) / np.linalg.norm(x[q].astype(float)) / np.linalg.norm(x[i].astype(float))), 6), i) for i in range(900) if i != q and i % 9 and i != 77]
            wanted[q] = (min(c)[1], -min(c)[0])
    df = vectors.nearest_in_facet(Held(spark, ""))
    got = {g.query: (g.nearest, g.cosine) for g in df.collect()}
    assert {q: n for q, (n, _) in got.items()} == {q: n for q, (n, _) in wanted.items()}
    assert all(abs(got[q][1] - wanted[q][1]) < 2e-6 for q in wanted)
