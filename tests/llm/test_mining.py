"""Secrets, vector codes and phrases against brute force, on odd rows, and their SQL on rows that the tables don't hold."""

import collections
import hashlib
import math
import random
import re
import string

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import same

from lodestone.llm import codes, phrases, secrets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, kind string, a long, id long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, texts, langs=None, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, langs[i] if langs else "en", "s", len(t or ""), "x", "y", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def duck(**tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(f"{name}_arrow", table)
        con.sql(f"create table {name} as select * from {name}_arrow")
    return con


# secrets


def entropy_by_hand(text):
    found = []
    for c in secrets.CLASSES:
        for m in re.finditer(f"[{c.characters}]+", text):
            if len(m[0]) < c.window or any(re.fullmatch(p, m[0]) for p in secrets.ALLOWED):
                continue
            covered = [False] * len(m[0])
            for o in range(len(m[0]) - c.window + 1):
                counts = collections.Counter(m[0][o : o + c.window])
                if -sum(n / c.window * math.log2(n / c.window) for n in counts.values()) >= c.bits - 1e-9:
                    covered[o : o + c.window] = [True] * c.window
            found += [(m.start() + r.start(), m.start() + r.end(), c.kind) for r in re.finditer("1+", "".join("01"[x] for x in covered))]
    return found


def spans_by_hand(text):
    base = []
    words = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    base += [(m.start(), m.end(), "assign") for m in words.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    more = [x for x in entropy_by_hand(text) if not any(b[0] <= x[0] and x[1] <= b[1] for b in base)]
    order = [*secrets.BASE, *[c.kind for c in secrets.CLASSES]]
    return sorted(base + more, key=lambda x: (x[0], order.index(x[2])))


def secret_texts():
    r = random.Random(3)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    base64 = string.ascii_letters + string.digits + "+/"
    return [
        f"Été 日本 token = \"{some('0123456789abcdef', 40)}\" and PassWord: 'hunter2-is-long'",
        f"key {some(base64, 44)}= then {some(base64, 23)} {some(base64, 24)}",
        f"AKIA{some(string.ascii_uppercase, 12)} AKIA{some(string.ascii_uppercase, 11)} xAKIAKIA{some(string.digits, 20)}",
        some("0123456789abcdef", 31) + " " + some("0123456789ABCDEF", 64) + "zz" + some("0123456789abcdef", 32),
        "token: api_key: abcdefghij secret=short secret==x.y_z-1234 apikey='a b' api_key=>12345678",
        "toKen=abcdefgh toKen=abcdefgh ſecret=abcdefgh",
        "a-plain-kebab-case-identifier-of-words ThisIsACamelCaseIdentifierHere /usr/local/share/documentation/of/things",
        "123e4567-e89b-12d3-a456-426614174000 2021-03-04-05-06-07-08-09-10-11 ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
        some("ab", 400) + " " + "".join(some(base64, 40) + "a" * 60 for _ in range(30)),
        "token" + " " * 5000 + "= abcdefghijk",
        some(base64, 20000),
        "",
        None,
        " \n ",
    ]


def test_secrets(spark):
    texts = secret_texts()
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in secrets.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == spans_by_hand(t or ""), i
    kinds = collections.Counter(k for x in got.values() for _, _, k in x)
    assert min(kinds[k] for k in (*secrets.BASE, "entropy_hex", "entropy_base64")) > 0
    assert got[6] == got[7] == []


def test_secrets_sql_and_odd_rows(spark, tmp_path):
    texts, ids = [*secret_texts(), "token=abcdefgh", "token=abcdefgh"], [*range(14), 3, None]
    df = frame(spark, texts, ids=ids)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    same(secrets.query(spark, str(tmp_path)), duck(documents=pa.table({"doc_id": ids, "text": texts})), secrets.SQL)
    assert secrets.scan(df.limit(0)).count() == 0
    none = secrets.scan(df, allowed=()).where("doc_id = 7").first().spans
    assert "entropy_base64" in {s.kind for s in none}  # what the allow-list suppresses


# vector codes


def lloyd_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = sorted((i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    points = np.array([[math.floor(1024 * x) for x in v] for _, v, _ in kept], object).reshape(len(kept), parts, -1)
    books = [[list(points[r, k]) for r in range(min(entries, len(kept)))] for k in range(parts)]

    def assigned(k):
        out = []
        for p in points[:, k]:
            apart = [sum((x - y) ** 2 for x, y in zip(p, z)) for z in books[k]]
            out.append((apart.index(min(apart)), min(apart)))
        return out

    for _ in range(rounds):
        for k in range(parts):
            to = [e for e, _ in assigned(k)]
            for e in set(to):
                own = [points[r, k] for r in range(len(to)) if to[r] == e]
                books[k][e] = [sum(x) // len(own) for x in zip(*own)]
    final = [assigned(k) for k in range(parts)]
    coded = [(kept[r][0], "".join(f"{final[k][r][0]:02x}" for k in range(parts)), sum(final[k][r][1] for k in range(parts)), kept[r][2]) for r in range(len(kept))]
    return coded, hashlib.sha256(",".join(str(x) for b in books for z in b for x in z).encode()).hexdigest()


def vector_rows(n=400, d=8, seed=5):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in r.integers(-3, 4, d) / 16 + r.integers(-2, 3, d) / 4096], int(i % 3) if i % 5 else None) for i in r.permutation(n)]
    rows += [(n + i, rows[0][1], 7) for i in range(150)]  # a crowd of equal vectors
    return [*rows, (9000, None, 1), (9001, [None, *[0.0] * (d - 1)], 1), (9002, [float("nan")] * d, None), (9003, [float("-inf"), *[0.0] * (d - 1)], 2)]


VECTORS = "vec_id bigint, embedding array<double>, label int, code string, part int, error long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)


@pytest.mark.parametrize("points,entries,spread", [(1, 1, 3), (9, 4, 1), (700, 40, 2), (3000, 256, 200)])
def test_filtered_assignment_is_the_nearest_entry(points, entries, spread):
    r = np.random.default_rng(points)
    p, book = r.integers(-spread, spread + 1, (points, 5)), r.integers(-spread, spread + 1, (entries, 5))
    tree = codes.Tree.build(p)
    nearest, sums, counts = tree.assign(book)
    wanted = ((p[:, None] - book[None]) ** 2).sum(2).argmin(1)
    got = np.empty(points, np.int64)
    got[tree.order] = nearest
    total = np.zeros_like(book)
    np.add.at(total, wanted, p)
    assert (got == wanted).all() and (sums == total).all() and (counts == np.bincount(wanted, minlength=entries)).all()


def test_whole_subtrees_are_assigned(monkeypatch):
    r = np.random.default_rng(1)
    centres = r.integers(-5000, 5000, (16, 4))
    tree = codes.Tree.build(centres[r.integers(0, 16, 4000)] + r.integers(-20, 21, (4000, 4)))
    met = []
    leaves = codes.Tree._leaves
    monkeypatch.setattr(codes.Tree, "_leaves", lambda self, book, edges, node, *more: (met.append(len(np.unique(node))), leaves(self, book, edges, node, *more)))
    _, _, counts = tree.assign(centres)
    assert counts.sum() == 4000 and sum(met) < 60  # of 512 leaves


@pytest.mark.parametrize("parts", [1, 3])
def test_vector_codes(spark, parts):
    rows = vector_rows()
    found, books = codes.compress(vectors(spark, rows).repartition(parts))
    wanted, digest = lloyd_by_hand(rows)
    assert sorted((r.vec_id, r.code, r.error, r.label) for r in found.collect()) == sorted(wanted, key=lambda x: x[0])
    assert codes.digest(books) == digest


def test_vector_codes_of_few_rows_and_ties(spark, tmp_path):
    same_id = [(1, [0.5, 0.25, 0.0, -0.001], 1), (1, [0.5, 0.0, 0.0, 1.0], None), (2, [0.5, 0.25, 0.0, -0.001], None), (None, [1.0, 1.0, 1.0, 1.0], 2)]
    vectors(spark, same_id).write.parquet(f"{tmp_path}/embeddings.parquet")
    table = pa.table({"vec_id": [r[0] for r in same_id], "embedding": [r[1] for r in same_id], "label": [r[2] for r in same_id]})
    same(codes.query(spark, str(tmp_path)), duck(embeddings=table), codes.SQL)
    for nothing in ([], [(1, None, 2)]):
        found, books = codes.compress(vectors(spark, nothing))
        assert found.count() == 0 and books.size == 0
    with pytest.raises(Exception, match="one length"):
        codes.compress(vectors(spark, [(1, [1.0, 2.0, 3.0], 1)]))
    with pytest.raises(Exception, match="4 components"):
        codes.compress(vectors(spark, [(i, [1.0] * 4, 1) for i in range(300)] + [(999, [1.0] * 8, 1)]))[0].count()
    with pytest.raises(Exception, match="can't be coded"):
        codes.compress(vectors(spark, [(1, [1e9, 2.0, 3.0, 4.0], 1)]))


# phrases


def phrases_by_hand(texts, langs, least, top):
    count, n = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in zip(texts, langs):
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        candidates = [g for g in c if len(g) > 1 and c[g] >= least]
        rows = []
        for g in candidates:
            if any(len(x) > len(g) and 100 * c[x] >= 80 * c[g] and any(x[i : i + len(g)] == g for i in range(len(x))) for x in candidates):
                continue
            score, _, left, right = min((2000000 * c[g] // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -c[g], " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrase_texts():
    r = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["Été", "日本", "x-1", "A", "a", "de", "de"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "", "", ",", ".", "\n", "\t"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    return [*texts, *["one fixed phrase here; one fixed phrase there"] * 40, None, "", " \t ", "...", "de " * 5000, "long piece " * 3000 + "!" + "b c d e " * 2000]


@pytest.mark.parametrize("block", [200, phrases.BLOCK])
def test_phrases(spark, monkeypatch, block):
    monkeypatch.setattr(phrases.word_blocks, "__defaults__", (block,))
    texts = phrase_texts()
    langs = ["fr" if i % 3 == 0 else None if i % 3 == 1 else "und" for i in range(len(texts))]
    got = phrases.collocations(frame(spark, texts, langs).repartition(3), top=70)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(texts, langs, 30, 70)


def test_phrases_sql_and_odd_rows(spark, tmp_path):
    texts = phrase_texts()
    langs = ["fr" if i % 2 else None for i in range(len(texts))]
    df = frame(spark, texts, langs, ids=[None if i % 4 == 0 else 1 for i in range(len(texts))])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    same(phrases.query(spark, str(tmp_path)), duck(documents=pa.table({"text": texts, "lang": langs})), phrases.SQL)
    for nothing in (df.limit(0), df.where("text is null"), frame(spark, ["two words"])):
        assert phrases.collocations(nothing).count() == 0


def test_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**15, [10**16, 9 * 10**15], [10**16, 9 * 10**15])], "a long, begins array<long>, ends array<long>")
    assert row.select(phrases.best_cut(2).alias("s")).first().s.score == 2000000 * 9 * 10**15 // (2 * 10**16)


def test_long_texts_are_cut_behind_piece_ends():
    data = np.frombuffer(b"aa bb. cc dd, ee ff gg hh ii jj kk! x", np.uint8)
    edges, owner = phrases.cut_long(data, np.array([0, 30, len(data)]), 5)
    parts = [bytes(data[s:e]) for s, e in zip(edges, edges[1:])]
    assert parts == [b"aa bb.", b" cc dd,", b" ee ff gg hh ii j", b"j kk!", b" x"] and owner.tolist() == [0, 0, 0, 1, 1]
