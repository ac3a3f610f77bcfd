"""Classifiers on held-out texts, the fold rule, and the pipeline."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, toxicity
from lodestone.llm.common import fold

RED, BLUE = ["karo", "limpe", "sodu", "vask", "orin", "teful"], ["xhen", "qyab", "zwij", "muxo", "qopt", "jewz"]


def language_rows(n=240, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        side = r.random() < 0.5
        rows.append((i, " ".join(r.choice(RED if side else BLUE) for _ in range(20)), "red" if side else "blue"))
    return rows


def test_language_id(spark):
    rows = [*language_rows(), (900, None, "red"), (901, "", "blue"), (902, "123 !?", "red"), (903, "Karo Limpe", None), (904, "qopt " * 60_000, None)]
    docs = spark.createDataFrame([(*r, "lang?") for r in rows], "doc_id bigint, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    held = [(i, lang) for i, _, lang in language_rows() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20 and sum(got[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "red", "blue"]
    assert all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(docs.repartition(5))).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(docs)).collect()] == [("und", 0.0)]
    assert langid.identify(docs.where("false"), langid.fit(docs)).count() == 0


def toxic_rows(n=700, seed=5):
    r = random.Random(seed)
    calm = ["the", "river", "stone", "walk", "green", "window", "paper", "music", "table", "cloud", "garden", "letter"]
    bad = ["grumblek", "snotfast", "vilderpox"]
    rows = []
    for i in range(n):
        w = [r.choice(calm) for _ in range(40)]
        toxic = int(r.random() < 0.3)
        if toxic:
            w[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(w[:20]) + ". " + " ".join(w[20:]) + ".", toxic))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (5002, "!!! ...", "x"), (5003, "river " * 50_000, "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None), (99999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == y for i, y in held) >= 0.97 * len(held)
    assert all(got[i] < 0.5 for i in (5000, 5001, 5002, 5003))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in got.values())
    odd = [(1, "the river g.r.u.m.b.l.e.k stone"), (2, "the snotxfast walk"), (3, "green VILDERPOX table"), (4, "green garden letter"), (5, "the g r u m b l e k walk"), (6, "the g - r - u - m - b - l - e - k walk"), (7, "paper grum blek cloud"), (8, "music v*i*l*d*e*r*p*o*x")]
    seen = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(odd, "doc_id bigint, text string"), model).collect()}
    assert seen[4] < 0.5 and all(seen[i] >= 0.5 for i in seen if i != 4), seen
    # a text's score comes from its own bytes: alone, in any batch, in any order, however often
    texts = [t for _, t in odd] + [t for _, t, _ in rows[:60]] + ["", None, "!!!", "the gruxmbxlek"]
    alone = [model.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert alone == model.scores(pa.array(texts, pa.string())).tolist()
    assert alone[::-1] == model.scores(pa.array(texts[::-1], pa.string())).tolist()
    twice = spark.createDataFrame([("a", t) for t in [*texts, *texts]], "doc_id string, text string")
    assert sorted(r.score for r in toxicity.toxicity(twice, model).collect()) == sorted([*alone, *alone])
    assert toxicity.toxicity(docs.where("false"), model).count() == 0 and toxicity.keep_clean(docs.where("false"), model).count() == 0
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert (again.weights == model.weights).all() and (again.slope, again.offset, again.least) == (model.slope, model.offset, model.least)


def slow_features(window):
    """All subsequences of four bytes within six, each with DECAY to the number of bytes skipped, by plain loops."""
    out = collections.defaultdict(float)
    for s in range(len(window)):
        for rest in itertools.combinations(range(s + 1, min(s + toxicity.SPAN, len(window))), 3):
            out[bytes(window[i] for i in (s, *rest))] += toxicity.DECAY ** (rest[-1] - s - 3)
    return out


def test_subsequence_kernel_matches_a_slow_one():
    texts = [" the river ", " stone walk green ", " grumblek ", " gruxmblek ", " ab ", " aaaaaaaaaaaa ", " the river the river "]
    flat = "".join(texts).encode()
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    found = toxicity.vectors(np.frombuffer(flat, np.uint8), starts, ends)
    slow = [slow_features(t.encode()) for t in texts]
    dot = lambda x, y: sum(v * y[k] for k, v in x.items() if k in y)
    want = np.array([[dot(x, y) / max(1e-9, math.sqrt(dot(x, x) * dot(y, y))) for y in slow] for x in slow])
    assert np.abs(toxicity.gram(found, found, block=3) - want).max() < 1e-4
    # the machine's rate of a window is the sum over the same subsequences
    weights = np.random.default_rng(1).integers(-1000, 1000, 1 << toxicity.BITS).astype(np.int32)
    rated = toxicity.rate(toxicity.running(np.frombuffer(flat, np.uint8), weights), starts, ends)
    for r, t in zip(rated, texts):
        total = 0.0
        for s in range(len(t)):
            for rest in itertools.combinations(range(s + 1, min(s + toxicity.SPAN, len(t))), 3):
                x = [t.encode()[i] for i in (s, *rest)]
                h = sum(b * int(f) for b, f in zip(x, toxicity._FACTORS)) & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                total += weights[h >> 32 - toxicity.BITS] * toxicity.DECAY ** (rest[-1] - s - 3)
        assert r == pytest.approx(total / math.sqrt(len(t)))


def test_windows_lie_in_sentences():
    texts = ["One two three four five. Six, seven!", "a b c d", "", "x", "no-one i - d - i ok\ni d"]
    raw = [t.encode() for t in texts]
    found = toxicity.words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    said = lambda width: [(int(t), bytes(found.data[s:e]).decode()) for s, e, t in zip(*found.windows(width))]
    assert said(1) == [(0, f" {w} ") for w in "one two three four five six seven".split()] + [(1, " abcd "), (3, " x "), (4, " noone "), (4, " idi "), (4, " ok "), (4, " i "), (4, " d ")]
    assert said(4) == [(0, " one two three four "), (0, " two three four five "), (0, " six seven "), (1, " abcd "), (3, " x "), (4, " noone idi ok "), (4, " i d ")]


def test_toxicity_without_two_labels(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int"))
    assert [r.score < 0.5 for r in toxicity.toxicity(docs, model).collect()] == [True]


def test_fold(spark):
    ids = [0, 1, 17, -4, 10**12]
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select(fold(F.col("i"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in ids]


def test_pipeline_stages_on_odd_rows(spark, tiny):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p
    from lodestone.llm.common import cut

    own = " ".join(f"own{i}" for i in range(40))
    leak = spark.read.parquet(f"{tiny}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, own, "en", "a", 5), (1, own, "en", "a", 5), (2, own + " more", "en", "a", 5), (1, "another text of the same id", None, None, None), (None, own, "en", None, 1), (None, None, None, None, None)]
    rows += [(3, None, "en", "a", None), (4, "", "en", "b", 0), (5, " \t", "en", "b", 2), (6, "word " * 50_000, "en", "c", 250_000), (7, f"x {leak} y", "de", "a", 3), (8, "日本語のテキスト", "ja", "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = []
    for name, stage in p.STAGES:
        docs = cut(stage(spark, docs, tiny), f"odd-{name}")
        seen.append(sorted(((r.doc_id or 0), len(getattr(r, "text", "") or "")) for r in docs.collect()))
    toxic, near, clean, mixed, ids = seen
    assert toxic == sorted(((r[0] or 0), len(r[1] or "")) for r in rows)  # nothing toxic was learned from these
    gone = collections.Counter(toxic) - collections.Counter(near)
    assert gone == collections.Counter({(2, len(own) + 5): 1})  # the null id is linked with nothing, the other text of id 1 stays
    assert (7, len(leak) + 4) in near and (7, len(leak) + 4) not in clean and len(clean) == len(near) - 1
    assert {i for i, _ in mixed} <= {i for i, _ in clean} and all(n for _, n in mixed) and len(ids) == len(mixed)
    empty = spark.createDataFrame([], docs.schema if "text" in docs.columns else "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in p.STAGES:
        assert stage(spark, empty, tiny).count() == 0


def test_pipeline(spark, tiny):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p
    from lodestone.llm import decontaminate, neardup
    from lodestone.llm.common import cut, table

    docs = table(spark, tiny, "documents")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    seen = {}
    for name, stage in p.STAGES:
        before = docs
        docs = cut(stage(spark, docs, tiny), name)
        seen[name] = docs
        if name != "token_output":
            assert docs.columns == before.columns
        if name in names[:3]:
            assert docs.count() <= before.count() and docs.exceptAll(before).count() == 0
    assert neardup.near_duplicates(seen["near_duplicates"], 80).where("not kept").count() == 0
    assert decontaminate.contamination(seen["decontamination"], table(spark, tiny, "benchmark")).where("n_hit > 0").count() == 0
    assert seen["token_output"].count() == seen["mixing"].count()
    assert p.run(spark, tiny).count() == seen["token_output"].count()


def test_training_memory_does_not_follow_long_texts():
    import tracemalloc

    rng = np.random.default_rng(5)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(3, 9, 3000)]
    texts = [". ".join(" ".join(rng.choice(names, 9)) for _ in range(900)) for _ in range(80)]
    labels = [i % 2 for i in range(80)]
    texts = [t + " you vile gruntling" * y for t, y in zip(texts, labels)]
    tracemalloc.start()
    try:
        toxicity.train(texts, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, texts)) > 4 << 20
    assert peak < 140 << 20


def test_training_leaves_the_driver(spark, monkeypatch):
    rows = toxic_rows(200)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    drawn = toxicity.sample(docs, labels)
    here = toxicity.train([t for t, _ in drawn], [y for _, y in drawn])
    monkeypatch.setattr(toxicity, "svm", None)  # a worker has its own
    model = toxicity.fit(docs, labels)
    texts = pa.array([r[1] for r in rows])  # a driver's sums over several threads end in other last digits
    assert ((model.scores(texts) >= 0.5) == (here.scores(texts) >= 0.5)).all()
