"""Exact operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, lines, mixing, neardup, spans, tokens, warc, words
from lodestone.llm.common import SPACE, running_totals, scratch
from lodestone.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words long, taken string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), True, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sample_texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "日本", "x-1"]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12)))
    base = ["\n".join(line() for _ in range(r.randint(1, 8))) for _ in range(n)]
    copies = [base[i] for i in range(0, n, 7)]
    near = [" ".join([*base[i].split(" ")[:-1], "changed"]) for i in range(0, n, 5)]
    return [*base, *copies, *near, None, "", " \t\n ", "one", "Shared Boilerplate Line\nother", "  shared boilerplate line \nmore", "a. b! c? " * 3000, " nbsp wide"]


def test_line_dedup(spark):
    texts = sample_texts()
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, texts)).collect()}
    first, keys = {}, {}
    for i, t in enumerate(texts):
        keys[i] = [x.strip(SPACE).translate(LOWER) for x in (t or "").split("\n")]
        for k in set(keys[i]):
            first.setdefault(k, []).append(i)
    for i, t in enumerate(texts):
        gone = [len(k) >= 10 and len(first[k]) >= 2 and i != first[k][0] for k in keys[i]]
        kept = "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g)
        assert (got[i].kept_text, got[i].n_lines, got[i].n_dropped) == (kept, len(gone), sum(gone)), i


def test_line_dedup_of_repeated_ids_and_nulls(spark):
    df = frame(spark, ["a shared line here", "a shared line here", "a shared line here", None], ids=[5, 5, 2, None])
    got = sorted((r.doc_id or -1, r.kept_text) for r in lines.dedup_lines(df).collect())
    assert got == [(-1, ""), (2, "a shared line here"), (5, ""), (5, "")]
    three = lines.dedup_lines(frame(spark, ["a shared line here"] * 2 + ["another line here"] * 3), min_docs=3)
    assert [r.n_dropped for r in three.orderBy("doc_id").collect()] == [0, 0, 0, 1, 1]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts, percent):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    changed = True
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            m = min(label[i], label[j])
            if label[i] != m or label[j] != m:
                label[i] = label[j] = m
                changed = True
    return sets, label


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    r = random.Random(4)
    base = [[f"v{r.randint(0, 999)}" for _ in range(80)] for _ in range(6)]
    texts = sample_texts(2)
    for b in base:
        for k in range(25):  # chains of ever more different copies
            w = list(b)
            for _ in range(k // 5):
                w[r.randrange(80)] = f"n{r.randint(0, 99)}"
            texts.append(" ".join(w).upper() if k % 2 else "  ".join(w))
    sets, label = brute_components(texts, percent)
    got = {x.doc_id: x for x in neardup.near_duplicates(frame(spark, texts), percent).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(s), c) for s, c in zip(sets, label)]
    assert all(got[i].kept == (label[i] == i) for i in got)


def test_near_duplicates_keep_no_scratch_files(spark):
    from lodestone.llm.common import shared_dir

    def folders():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        return {f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}

    before = folders()
    found = neardup.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", "x"]))
    assert [x.rsplit("-", 1)[0] for x in folders() - before] == ["lodestone-near-duplicates"]
    assert found.where("not kept").count() == 1


def test_near_duplicates_edges(spark):
    got = neardup.near_duplicates(frame(spark, ["a b c", "A  B c", "a b", None, "a b c"], ids=[4, 3, 2, 1, None])).collect()
    assert sorted(((r.doc_id or -1), r.component_id, r.kept) for r in got) == [(-1, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False)]
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_crowd_in_large_nodes_is_one_component(spark):
    r = random.Random(9)
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join(base[:30] + [f"x{i}"] + base[30:]) for i in range(80)]
    docs = frame(spark, texts)
    signed = neardup.signatures(docs).selectExpr("doc_id rep", "n_shingles n", "sig")
    found = neardup.candidates(neardup.meetings(signed, trees=4, depth=2, small=8), signed, 80)
    label = components(found.select("a", "b"))
    assert label.count() == 80 and label.select("component").distinct().count() == 1
    assert found.count() < 80 * 40 and r


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_where_every_node_is_large(percent):
    """Pairs that agree on so many coordinates, followed down all levels as if no node on the way were small: do they still meet?"""
    r = np.random.default_rng(3)
    pairs = 2000
    left = r.integers(0, 1 << 32, (pairs, neardup.COORDINATES), dtype=np.uint32)
    right = np.where(r.random(left.shape) < percent / 100, left, r.integers(0, 1 << 32, left.shape, dtype=np.uint32))
    met = np.zeros(pairs, bool)
    for tree in range(neardup.TREES):
        sides = []
        for sig in (left, right):
            node, row = np.full(pairs, neardup.words.mixed(np.array([tree + 1], np.uint64))[0]), np.arange(pairs)
            for _ in range(neardup.DEPTH):
                node, which = neardup.children(node, sig[row])
                row = row[which]
            sides.append(set(zip(row.tolist(), node.tolist())))
        met[[i for i, _ in sides[0] & sides[1]]] = True
    assert met.mean() >= 0.9


@pytest.mark.parametrize("size", [20, 200, 3000])
def test_estimates_leave_no_similar_pair_out(size):
    r = np.random.default_rng(size)
    sets, true = [], []
    for _ in range(400):
        both = r.integers(0, 1 << 63, size, dtype=np.uint64)
        own = int(size * r.uniform(0, 0.3))
        sets += [np.unique(np.concatenate([both[own:], r.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(2)]
        true.append(len(np.intersect1d(*sets[-2:])) / len(np.union1d(*sets[-2:])))
    n, bins = np.array([len(s) for s in sets]), neardup.sketches(sets).view(np.uint64)
    est, can = neardup.estimated(bins[::2], bins[1::2], n[::2], n[1::2], 85)
    true = np.array(true)
    assert can[true >= 0.85].all() and not can[true < {20: 0.6, 200: 0.75, 3000: 0.75}[size]].any()
    assert np.abs(est / 1000 - true).max() < 0.1


def test_ids_that_are_text_or_repeat(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [("x", a), ("y", a + " more"), ("x", b), ("z", b), ("w", "alone here")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [("w", 1, "w", True), ("x", 56, "x", True), ("x", 56, "x", True), ("y", 57, "x", False), ("z", 56, "x", False)]


def test_large_nodes_are_compared_whole(spark):
    r = random.Random(12)
    crowd = []
    for k in range(60):  # about 0.7 alike, and to each a partner 0.9 alike
        own = [f"v{i}" for i in range(300)]
        for at in range(12, 300, 36):
            own[at] = f"o{k}-{at}"
        crowd += [" ".join(own), " ".join([*own[:-4], *(f"p{r.randint(0, 10**6)}" for _ in range(4))])]
    crowd = frame(spark, crowd)
    signed = neardup.signatures(crowd).selectExpr("doc_id rep", "n_shingles n", "sig")
    met = neardup.meetings(signed, trees=1, depth=1, small=4)
    whole = neardup.meetings(signed, trees=1, depth=1, small=10**6)
    pair = lambda m: {(a.rep, b.rep) for rows in nodes(m).values() for a in rows for b in rows if a.rep < b.rep and (a.side != b.side or a.side == 0)}
    assert pair(met) == pair(whole)
    together = {p for p in pair(whole) if p[0] % 2 == 0 and p[1] == p[0] + 1}
    found = {(x.a, x.b) for x in neardup.candidates(met, signed, 85).collect()}
    assert len(together) > 30 and together <= found


def test_shared_counts():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, high, n).astype(np.uint64)) for high, n in [(50, 30), (50, 40), (10**9, 300), (400, 1), (40_000, 30_000), (40_000, 30_000)] * 3]
    x, y = map(np.array, zip(*[(i, j) for i in range(len(sets)) for j in range(i)]))
    assert neardup.shared_counts(sets, x, y).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)]
    lone = [np.array([k], np.uint64) for k in range(3)]
    assert neardup.shared_counts(lone, np.array([0, 1]), np.array([1, 2])).tolist() == [0, 0]


def test_a_pair_is_checked_in_one_of_its_nodes():
    r = random.Random(6)
    member = {i: sorted({r.randint(-5, 5) for _ in range(r.randint(0, 5))}) for i in range(30)}
    checked = collections.Counter()
    packed = {i: np.array(n, ">i8").tobytes() for i, n in member.items()}
    for node in range(-5, 6):
        inside = [i for i in member if node in member[i]]
        x, y = (np.array([p[k] for p in [(i, j) for i in range(len(inside)) for j in range(i)]], np.int64) for k in (0, 1))
        own = neardup.first_meetings(np.full(len(inside), node), [packed[i] for i in inside], x, y)
        checked.update((inside[i], inside[j]) for i, j in zip(x[own], y[own]))
    assert set(checked) == {(i, j) for i in member for j in range(i) if set(member[i]) & set(member[j])} and set(checked.values()) == {1}
    cell = neardup.first_meetings(np.full(2, 99), [packed[0], np.array([77], ">i8").tobytes()], np.array([0]), np.array([1]))
    assert cell.tolist() == [True]  # a cell of a large node, where they share no small one


@pytest.mark.parametrize("small", [8, 4096])
def test_a_crowd_under_the_threshold_with_a_few_links(spark, monkeypatch, small):
    monkeypatch.setattr(neardup.meetings, "__defaults__", (neardup.TREES, 3, small))
    r = random.Random(8)
    base, texts = [f"v{i}" for i in range(200)], []
    for k in range(70):  # 0.84 alike, and every seventh has a close copy
        own = list(base)
        for f in range(4):
            own[20 + 40 * f] = f"o{k}-{f}"
        texts.append(" ".join(own))
        if k % 7 == 0:
            own[r.randrange(200)] = "changed"
            texts.append(" ".join(own))
    _, label = brute_components(texts, 85)
    assert 50 < len(set(label)) < len(texts)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, texts), 85).collect()}
    assert got == dict(enumerate(label))


def nodes(met):
    held = collections.defaultdict(list)
    for x in met.collect():
        held[x.node].append(x)
    return held


def test_two_tight_groups_linked_only_across(spark, monkeypatch):
    groups = []
    for side in "xy":  # 0.97 alike inside, 0.86 to 0.88 across
        base = [f"v{i}" for i in range(300)]
        for at in (50, 120, 190):
            base[at] = side
        groups += [" ".join([*base, f"{side}{k}"]) for k in range(10)]
    sets, label = brute_components(groups, 85)
    assert set(label) == {0}
    signed = neardup.signatures(frame(spark, groups)).selectExpr("doc_id rep", "n_shingles n", "sig")
    assert components(neardup.candidates(neardup.meetings(signed), signed, 85).select("a", "b")).select("component").distinct().count() == 2  # the first round alone
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, groups), 85).collect()}
    assert got == dict(enumerate(label))
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 700)  # a node's sets in many cells
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, groups), 85).collect()}
    assert got == dict(enumerate(label))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[60] == got[100] == got[50] == 50


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_contamination(texts, items):
    out = []
    for t in texts:
        w, hit, found = bench_words(t), set(), set()
        for i, x in items:
            iw = bench_words(x)
            k = min(10, len(iw))
            if not k:
                continue
            windows = {tuple(iw[s : s + k]) for s in range(len(iw) - k + 1)}
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    found.add(str(i))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_contamination(spark):
    r = random.Random(5)
    words = [f"b{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(10, 30)))) for i in range(12)] + [(20, "Two words"), (21, "single"), (22, ""), (23, None), (24, "the the the the the the the the the the the"), (20, "other text of the same item id with more than ten words in it")]
    texts = [*sample_texts(3), None]
    for i, x in items[:12]:
        w = bench_words(x)
        texts += [f"start {x} end", " ".join(w[2:13]).upper(), " ".join(w[:9]), f"{x}, {x}", " ".join([*w[:5], "gap", *w[5:]])]
    texts += ["two words", "a SINGLE b single", "the " * 40, "two-words; single", "the other text of the same item id with more than ten words in it all"]
    got = {x.doc_id: x for x in decontaminate.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for i, want in enumerate(brute_contamination(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == want, (i, texts[i])


def test_items_that_share_a_prompt(spark):
    prompt = " ".join(f"p{i}" for i in range(25))
    items = [(i, f"{prompt} own{i} " + " ".join(f"q{i}-{j}".replace("-", "x") for j in range(12))) for i in range(40)] + [(41, "lone"), (41, prompt)]
    texts = [f"a {prompt} b", items[3][1], "x " * 30 + "lone", " ".join(["p0"] * 500), " ".join(f"p{i}" for i in range(9)), None, f"a {prompt} b"]
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for i, want in enumerate(brute_contamination(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == want, i
    named = spark.createDataFrame([("x", f"{prompt}"), (None, "lone"), ("x", f"{prompt}")], "doc_id string, text string")
    found = decontaminate.contamination(named, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id or "", r.n_hit, len(r["items"])) for r in found) == [("", 1, 1), ("x", 25, 41), ("x", 25, 41)]


def test_contamination_edges(spark):
    none = decontaminate.contamination(frame(spark, ["a b c"]), spark.createDataFrame([], "item_id bigint, text string")).collect()
    assert [(r.n_words, r.n_hit) for r in none] == [(3, 0)]
    one = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    got = decontaminate.contamination(frame(spark, ["x a b c", "x a b c", "q"], ids=[7, 7, None]), one).collect()
    assert sorted((r.doc_id or -1, r.n_hit) for r in got) == [(-1, 0), (7, 3), (7, 3)]
    assert decontaminate.contamination(frame(spark, []), one).count() == 0


def test_spans(spark):
    passage = "This passage has several short sentences. It repeats in many documents. Each sentence adds words! Do we find all of them? Yes we do find them all. The end of it is here now."
    r = random.Random(8)
    own = lambda: " ".join(f"q{r.randint(0, 10**6)}" for _ in range(30)) + "."
    texts = [own() + " " + passage + " " + own(), own(), own() + "\n" + passage.upper() + "\n" + own(), passage, None, "", "word " * 4000, own() + " " + passage + " " + own() + " " + passage]
    got = {x.doc_id: x for x in spans.dedup_spans(frame(spark, texts)).collect()}
    assert got[0].n_removed == got[1].n_removed == got[4].n_removed == 0 and got[0].kept_text == texts[0]
    assert got[2].n_removed == got[3].n_removed == 6 and got[7].n_removed == 12
    assert "passage" not in got[2].kept_text.lower() and got[2].kept_text.startswith(texts[2][:30])
    assert got[3].kept_text.strip() == "" and got[4].kept_text == ""
    assert spans.dedup_spans(frame(spark, [])).count() == 0


def word_hashes(sentence):
    return [int(h) for w in sentence for h in spans.Sentences([w]).hash]


def pieces(sentence):
    """The pieces of a long sentence by the rule of the docstring, word by word."""
    if len(sentence) <= 25:
        return [sentence]
    h, mark = word_hashes(sentence), []
    for i in range(len(h)):
        x = h[i] * words.FACTOR + (h[i - 1] * words.BASE if i else 0) + (h[i - 2] * 0x2545F4914F6CDD1D if i > 1 else 0)
        mark.append(int(words.mixed(np.array([x % 2**64], np.uint64))[0]))
    out = [[]]
    for i, w in enumerate(sentence):
        if len(out[-1]) == 25:
            out.append([])
        out[-1].append(w)
        if all(mark[i] < mark[j] for j in range(max(0, i - 8), i)) and all(mark[i] <= m for m in mark[i + 1 : i + 9]):
            out.append([])
    return [p for p in out if p]


def split_sentences(text):
    """Sentences as lists of words, without the code under test but for the hash of a word."""
    parts = [x.split() for x in re.split(r"(?<=[.!?\n])(?![.!?\n])", text.lower())]
    return [q for p in parts if p for q in pieces(p)]


@pytest.mark.parametrize(("min_sentences", "min_words", "across", "chance"), [(2, 0, False, None), (2, 0, True, None), (3, 25, False, None), (2, 0, False, 0.001), (2, 0, False, 1e-12)])
def test_spans_match_brute_force(spark, min_sentences, min_words, across, chance):
    r = random.Random(11)
    pool = [" ".join(f"p{r.randint(0, 40)}" for _ in range(r.choice([1, 3, 7, 14, 40, 90]))) + r.choice([".", "!", "?!"]) for _ in range(60)]
    texts = [r.choice([" ", "\n"]).join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(60)]
    texts += [texts[3], texts[4].upper(), "One two three. Four five six seven eight nine ten.", "One two three. Four five six seven eight nine ten.", ". ! ?", "a.\n\n b"]
    split = [split_sentences(t) for t in texts]
    count = collections.Counter(h % spans.COUNTERS for parts in split for p in parts for h in word_hashes(p))
    tells = {k: round(256 * float(np.log2((count.total() + spans.COUNTERS - len(count)) / n))) for k, n in count.items()}
    weigh = lambda parts: sum(tells[h % spans.COUNTERS] for p in parts for h in word_hashes(p)) if chance else sum(map(len, parts))
    least = 256 * float(np.log2(sum(map(len, split)) / chance)) if chance else min_words
    weights = {id(p): weigh([p]) for parts in split for p in parts}
    held, gone = collections.defaultdict(list), collections.defaultdict(set)
    for i, parts in enumerate(split):
        for s in range(len(parts)):
            for e in range(s + min_sentences, len(parts) + 1):
                if sum(weights[id(p)] for p in parts[s:e]) >= least:
                    held[tuple(w for p in parts[s:e] for w in p)].append((i, s, e))
    for places in held.values():
        if not across or len({i for i, _, _ in places}) > 1:
            for i, s, e in places[1:]:
                gone[i] |= set(range(s, e))
    got = {x.doc_id: (x.n_sentences, x.n_removed) for x in spans.dedup_spans(frame(spark, texts), min_sentences, min_words, across, chance).collect()}
    assert got == {i: (len(split[i]), len(gone[i])) for i in range(len(texts))}
    assert any(gone.values())


def test_query_removes_short_and_own_repeats(spark, tmp_path):
    twice = "This passage of eighteen words comes two times. It lies in one document only and nowhere else here now."
    texts = ["One two three. Four five six seven eight.", "One two three. Four five six seven eight.", f"{twice} Between them. {twice}", None, ""]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in spans.query(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed for i in range(5)] == [0, 2, 2, 0, 0]
    assert got[1].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_spans_in_text_without_stops(spark):
    r = random.Random(15)
    own = lambda n: " ".join(f"q{r.randint(0, 10**6)}" for _ in range(n))
    passage = own(200)
    texts = [f"{own(7)} {passage} {own(40)}", f"{own(11)} {passage.upper()} {own(33)}", own(30), own(30), "word " * 400, "word " * 400]
    texts[3] = texts[2]
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n))
    shared = "".join(han(12) + "。" for _ in range(6))
    texts += [han(9) + "。" + shared + han(9) + "。", han(14) + "！" + shared + han(7) + "？", han(40) + shared[:0]]
    run = han(150)
    texts += [han(7) + run + han(20), han(12) + run + han(31)]
    got = {x.doc_id: x for x in spans.dedup_spans(frame(spark, texts)).collect()}
    assert all(got[i].n_removed == 0 for i in (0, 2, 6, 8, 9))
    assert got[1].n_chars_removed > 0.7 * len(passage) and texts[1].split()[0] in got[1].kept_text
    assert got[3].kept_text == got[5].kept_text.strip() == ""
    assert got[7].n_chars_removed >= len(shared) and got[10].n_chars_removed > 0.6 * len(run)


def test_mixing(spark):
    texts = sample_texts(6, 200)
    sources = [["big", "mid", None, "Zed"][min(3, i % 7)] for i in range(len(texts))]
    docs = frame(spark, texts, sources)
    got, plan = mixing.mix_sources(docs)
    rows = got.collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7))[0].collect()}
    assert {(r.doc_id, r.taken) for r in rows} == again and len(rows) == len(texts)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size
        b = by[sources[r.doc_id]]
        b[0] += r.size
        b[1] += r.taken
        b[2] = r.target
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * 9))
    total, full = 1.5 * sum(words.values()), set()
    while True:
        rest = total - sum(2 * by[s][0] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / free > 2 * by[s][0]}
        if not over:
            break
        full |= over
    for s in order:
        want = 2 * by[s][0] if s in full else rest * weight[s] / free
        assert by[s][2] == pytest.approx(want) and abs(by[s][1] - want) <= 0.03 * want + 3
    slots = [r.skey for r in plan.orderBy("slot").collect()]
    assert len(set(slots[: len(slots) // 4])) == len(order)  # every source shows early


def test_mixing_edges(spark):
    assert mixing.mix_sources(frame(spark, []))[0].count() == 0 and mixing.apply_mix(frame(spark, [])).count() == 0
    one = mixing.mix_sources(frame(spark, ["", None]))[0].collect()
    assert [(r.size, r.taken, r.target) for r in one] == [(0, 0, 0.0)] * 2
    assert mixing.apply_mix(frame(spark, ["", None, "a b"], ["s"] * 3)).select("doc_id").distinct().count() == 1
    dup = mixing.apply_mix(frame(spark, ["a b c d", "a b c d"], ["s", "s"], [1, 1])).collect()
    assert all(r.text in ("a b c d", "a b", "a b c", "a") for r in dup) and sum(len(r.text.split()) for r in dup) == 12


def test_apply_mix_gives_the_scheduled_blocks(spark):
    texts = sample_texts(7, 120)
    docs = frame(spark, [*texts, texts[0]], [["big", "mid", None][min(2, i % 5)] for i in range(len(texts))] + ["big"], [*range(len(texts)), 0])
    mix = mixing.plan(docs, block_words=16, min_blocks=8)
    line = collections.defaultdict(list)  # each source's words, end to end
    whole = dict(enumerate(texts))
    length = {}
    for r in mix.placed.orderBy("skey", "start").collect():
        length[r.skey] = r.L
        line[r.skey] += [(r.doc_id, w) for w in re.findall(r"[^\x20\x09-\x0D]+", whole[r.doc_id] or "")]
    want = collections.Counter()
    slots = mix.schedule.collect()
    for x in slots:
        want.update(line[x.skey][x.block * length[x.skey] : (x.block + 1) * length[x.skey]])
    rows = mixing.apply_mix(docs, in_order=True, block_words=16, min_blocks=8)
    assert rows.schema == docs.schema
    rows = rows.collect()
    got = collections.Counter((r.doc_id, w) for r in rows for w in re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == want and all(r.text in whole[r.doc_id] for r in rows) and all(len(r.text) == r.n_chars for r in rows)
    # each source's blocks go round from the first one on, and early slots' words come early
    for skey in line:
        own = sorted((x.slot, x.rank) for x in slots if x.skey == skey)
        assert [k for _, k in own] == list(range(len(own)))
    first = {r.doc_id: i for i, r in reversed(list(enumerate(rows)))}
    early = min(slots, key=lambda x: x.slot)
    assert first[line[early.skey][early.block * length[early.skey]][0]] <= 2


def test_a_source_of_many_cells_is_cut_by_many_tasks(spark):
    one = spark.sql("select 'a' skey, 5L blocks, 1e5D slots, 0L lo, 100000L hi union all select 'b', 5L, 1D, 100000L, 100000L")
    found = mixing.cells(one, lambda x: x, 100_000, chunk=64)
    tasks = found.where("skey = 'a'").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert found.count() == 100_002 and found.agg(F.sum("cell")).first()[0] == 100_001 * 50_000 + 100_000
    assert len(tasks) == 4 and max(t["count"] for t in tasks) < 40_000


def test_running_totals(spark):
    df = spark.range(5000).selectExpr("id % 3 as g", "xxhash64(id) as h", "id % 7 as v")
    want, total = [], 0
    for i, r in enumerate(sorted(map(tuple, df.collect()))):
        want.append((*r, i, total))
        total += r[2]
    assert sorted(map(tuple, running_totals(df, ["g", "h"], ["v"], "t").select("g", "h", "v", "idx", "v_before").collect())) == want


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, record_type string, payload_bytes int")


def test_warc(spark):
    body = "<html>" + "x é " * 200
    rows = [(5, "http://a/?q=é \n", body), (3, None, body), (9, "u", body), (1, "u", None), (2, "u", ""), (4, "u", "only"), (7, "u", "long" * 50_000)]
    rows += [(100 + i, f"http://b/{i}", f"<html><head><title>page {i}</title></head><body>common boilerplate of many pages, number {i}</body></html>" * 3) for i in range(80)]
    folder = scratch(spark, "warc-test")
    files = warc.write_archives(pages(spark, rows), folder)
    got = {r.page_id: r for r in warc.read_archives(files, folder).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert got[i].payload is None if got[i].record_type == "revisit" else bytes(got[i].payload) == raw
    assert [(got[i].record_type, got[i].refers_to) for i in (3, 5, 9, 1, 2, 4)] == [("response", None), ("revisit", 3), ("revisit", 3), ("response", None), ("revisit", 1), ("response", None)]
    first = open(files.first().file, "rb").read(4)
    assert int.from_bytes(first, "little") == warc.DICTIONARY_FRAME


def test_warc_edges(spark):
    folder = scratch(spark, "warc-empty")
    assert warc.read_archives(warc.write_archives(pages(spark, []), folder), folder).count() == 0
    folder = scratch(spark, "warc-ties")
    files = warc.write_archives(pages(spark, [(1, "a", "same"), (1, "b", "same"), (None, None, "same"), (2, "c", "tiny")]), folder, min_payload=5)
    assert {r.record_type for r in warc.read_archives(files, folder).collect()} == {"response"}
    with pytest.raises(ValueError):
        warc.parse_record(warc.record_bytes(1, "u", b"abc", "WRONG", None, "d"))


def test_tokens_match_the_library(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = [*sample_texts(9, 20), "İstanbul, É. <|endoftext|> <|ENDOFTEXT|> it's 12,5 a., ,b \x1c x́", "a." * 500, ",", "ß. ﬁ"]
    docs = frame(spark, texts, ids=[i // 2 if i < 4 else i for i in range(len(texts))])
    tool = Tokenizer.from_file(tokens.tokenizer_path())
    for encoding in ("dictionary", "delta"):
        out = scratch(spark, "tokens-test")
        tokens.write_tokens(docs, out, tokens.tokenizer_path(), encoding=encoding)
        rows = sorted(tokens.read_tokens(spark, out).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
        want = collections.Counter((i, tuple([*tool.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in zip([r.doc_id for r in docs.collect()], texts))
        assert collections.Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
        at = 0
        for r in rows:
            assert (r.start, r.n_tokens) == (at, len(r.ids))
            at += r.n_tokens
        for r in tokens.token_digests(tokens.read_tokens(spark, out)).collect():
            ids = next(x.ids for x in rows if x.start == r.start)
            assert r.ids_crc32 == zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
    assert tokens.read_tokens(spark, out, ("doc_id", "n_tokens")).columns == ["doc_id", "n_tokens"]


def test_tokens_of_nothing(spark):
    pytest.importorskip("public_tokenizers")
    assert tokens.token_table(frame(spark, [])).count() == 0
    one = tokens.token_table(frame(spark, [None, ""], ids=[None, 3])).collect()
    assert [r.n_tokens for r in one] == [1, 1]


def test_tokens_of_one_hash_and_other_tokenizers(monkeypatch):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = [*sample_texts(9, 12)[:12], "a., ,b 12,5 <|endoftext|>", "", "same same"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    want = [e.ids for e in Tokenizer.from_file(tokens.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    split = lambda ids, n: [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    known = tokens.WordIds(tokens.tokenizer_path())
    assert known.by_piece and split(*known.encode(data, at)) == want == split(*known.encode(data, at))
    known.by_piece = False  # as for a tokenizer whose normaliser or pre-tokenizer is another
    assert split(*known.encode(data, at)) == want
    known = tokens.WordIds(tokens.tokenizer_path())
    true = tokens.words.hashes
    monkeypatch.setattr(tokens.words, "hashes", lambda d, s, e: true(d, s, e) & np.uint64(3))  # nearly every two pieces meet
    assert split(*known.encode(data, at)) == want


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_have_encodings_row_groups_and_page_indexes(spark, encoding):
    pytest.importorskip("public_tokenizers")
    import glob

    import pyarrow.parquet as pq

    out = scratch(spark, "tokens-file")
    docs = frame(spark, sample_texts(3, 40) * 12).coalesce(1)
    tokens.write_tokens(docs, out, tokens.tokenizer_path(), encoding=encoding, row_group_bytes=1 << 14, page_bytes=1 << 10)
    files = [pq.ParquetFile(f) for f in glob.glob(out.removeprefix("file://") + "/*.parquet")]
    files = [f for f in files if f.metadata.num_rows]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    ids = [g.column(j) for g in groups for j in range(g.num_columns) if g.column(j).path_in_schema.startswith("ids")]
    wanted = {"PLAIN_DICTIONARY", "RLE_DICTIONARY"} if encoding == "dictionary" else {"DELTA_BINARY_PACKED"}
    assert ids and all(wanted & set(c.encodings) for c in ids) and all(c.has_offset_index and c.has_column_index for c in ids)
    assert len(groups) > len(files)
    some = tokens.read_tokens(spark, out, ("doc_id", "n_tokens")).where("doc_id = 7")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan or "EqualTo(doc_id,7)" in plan
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_warc_null_and_negative_ids(spark):
    folder = scratch(spark, "warc-null")
    files = warc.write_archives(pages(spark, [(-1, "a", "same text"), (None, "b", "same text"), (7, "c", "same text")]), folder)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(files, folder).collect()}
    assert got == {-1: ("response", None), None: ("revisit", -1), 7: ("revisit", -1)}


def test_warc_dictionary_comes_from_records_in_any_order(spark):
    rows = [(i, f"http://b/{i}", f"<html><title>page {i}</title><p>common boilerplate of many pages, number {i}</p></html>" * 4) for i in range(900)]
    heads = []
    for n in (1, 5):
        folder = scratch(spark, "warc-order")
        files = warc.write_archives(pages(spark, rows if n == 1 else rows[::-1]).repartition(n), folder)
        with open(files.first().file, "rb") as f:
            head = f.read(8)
            heads.append(f.read(int.from_bytes(head[4:], "little")))
    assert heads[0] == heads[1]
    import zstandard

    assert b"WARC-Type" in zstandard.ZstdDecompressor().decompress(heads[0]) or b"Content-Type: " in zstandard.ZstdDecompressor().decompress(heads[0])


def test_empty_tables(spark):
    assert lines.dedup_lines(frame(spark, [])).count() == 0
