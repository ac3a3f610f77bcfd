"""Pairs of sparse vectors by dense columns and postings against all products."""

import math

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import discovery


def task(x, first):
    at = [np.flatnonzero(v) for v in x]
    n = len(x)
    return pa.table({"task": pa.array([7] * n, pa.int32()), "side": pa.array([int(i >= first) for i in range(n)], pa.int32()), "id": [f"v{i:03d}" for i in range(n)],
                     "cols": pa.array([a.tolist() for a in at], pa.list_(pa.int32())), "ws": pa.array([v[a].tolist() for v, a in zip(x, at)], pa.list_(pa.float64()))})


def vectors():
    r = np.random.default_rng(3)
    x = r.random((150, 60)) * (r.random((150, 60)) < 0.08)
    x[0], x[1], x[2] = 0, 0, 0
    x[0, 50:54] = x[1, 50:52] = x[1, 54:56] = x[2, 54:58] = 0.5  # cosines of exactly 0.5
    x[3] = np.where(np.arange(60) < 8, x[3], 0)
    x[3, 0] = 1
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def components(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if k == old else k for k in label]
    return label


@pytest.mark.parametrize("first,least", [(150, 0.5), (60, 0.5), (149, 0.5), (60, 0.3)])
def test_links_of_a_task_are_those_of_all_products(monkeypatch, first, least):
    for name, value in (("BLOCK", 16), ("TILE", 11), ("HEAD", 8)):
        monkeypatch.setattr(discovery, name, value)
    x = vectors()
    cos = np.array([[math.fsum(a * b for a, b in zip(u, v) if a and b) for v in x] for u in x])
    wanted = [(i, j) for i in range(150) for j in range(i + 1, 150) if cos[i, j] >= least and (first == 150 or i < first <= j)]
    links = [p for b in discovery._compare(60, least)(iter(task(x, first).to_batches(max_chunksize=40))) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    got = components(150, [(int(a[1:]), int(b[1:])) for a, b in links])
    assert got == components(150, wanted) and len(links) < 150
    assert first < 150 or (got[0] == got[1] == got[2])


def test_only_vectors_that_share_a_term_cost_more_than_the_product(monkeypatch):
    """Terms beside the dense columns are met by their postings: entries that meet, not a vector's terms times a block."""
    met, add = [], np.add

    class Counted:
        def __call__(self, *a, **k):
            return add(*a, **k)

        def __getattr__(self, name):
            return getattr(add, name)

        def at(self, where, index, values):
            met.append(len(index))
            add.at(where, index, values)

    monkeypatch.setattr(discovery.np, "add", Counted())
    n, width = 400, 5000
    x = np.zeros((n, width))
    for i in range(n):
        x[i, 100 + 10 * i : 110 + 10 * i] = math.sqrt(0.1)
    links = [b.num_rows for b in discovery._compare(width, 0.5)(iter(task(x, n).to_batches()))]
    assert sum(links) == 0 and 10 * n <= sum(met) <= 2 * 10 * n


def test_links_are_made_once(spark, tmp_path):
    """Components read the links in both directions: what gives them is not run again."""
    docs = spark.createDataFrame([(f"d{i}", f"word{i % 7} other{i % 7} third{i % 3}") for i in range(40)], "id string, text string")
    links = discovery.eps_forest(discovery.tfidf(docs), 0.5)
    assert "MapInArrow" not in links._jdf.queryExecution().toString() and links.count()
