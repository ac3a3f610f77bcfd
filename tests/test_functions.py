"""Parsers, normalisers, chunker, resolution and control functions on literals."""

import hashlib
import math

import numpy as np
import plistlib
import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunks, contact_formats as cf, mail, rdf, text
from lodestone.operators import jobs, resolve
from lodestone.operators.common import norm_limit, web_search
from lodestone.operators.vectors import residual_basis
from lodestone.plans.fixpoint import reachable
from lodestone.plans.labels import smallest_reachable


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i").select(column).collect()]


def test_normalisers(spark):
    assert values(spark, ["+1 (555) 123-4567", "555-1234", "12", "tel:1234567"], text.phone("x")) == ["5551234567", "5551234", "", "1234567"]
    assert values(spark, [" HTTPS://www.A.example/b/ ", "www.c.example"], text.url("x")) == ["a.example/b", "c.example"]
    assert values(spark, ["mailto:A@B.example", "Some One <X@Y.example>"], text.email("x")) == ["a@b.example", "x@y.example"]
    assert values(spark, ["Ann  B.-Clark!", "--x--"], text.alias_slug("x")) == ["ann-b-clark", "x"]
    assert values(spark, ["Dr. Ann Lee, Jr.", "Mr"], F.array_join(text.name_tokens("x"), "|")) == ["ann|lee", ""]
    assert values(spark, [" <<A@B>> ", ""], text.message_id("x")) == ["<a@b>", ""]
    assert values(spark, ["a", ""], text.stable_uid("x")) == [97, 1]


def test_body_fingerprint_ignores_blank_lines_and_spacing(spark):
    a, b, c = values(spark, ["x  y\r\n\r\nz", "x y\nz\n\n", "x y z"], text.body_fingerprint("x"))
    assert a == b != c


def test_snippet(spark):
    got = values(spark, ["a <b> Needle & more", "nothing", "x" * 100 + " needle " + "y" * 200], text.snippet("x", "needle"))
    assert got[0] == "a &lt;b&gt; <mark>Needle</mark> &amp; more"
    assert got[1] is None and got[2].startswith("...") and got[2].endswith("...")


def test_web_search(spark):
    rows = ["red apple pie", "green apple", "apple pie red", ""]
    hit = lambda q: values(spark, rows, web_search(F.col("x"), q))
    assert hit("apple red") == [True, False, True, False]
    assert hit('"red apple"') == [True, False, False, False]
    assert hit("green or pie -red") == [False, True, False, False]
    assert hit("  ") == [False] * 4


def test_limits():
    assert [norm_limit(x) for x in (None, 0, -1, 7, 5000)] == [50, 50, 50, 7, 1000]


def test_mbox_and_message():
    raw = b"From a Mon\nMessage-ID: <A@x>\nSubject: =?utf-8?q?caf=C3=A9?=\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>rich</p>\n--B\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=f.txt\n\nfile\n--B--\n\nFrom b Tue\nSubject: two\n\n>From here\n"
    parts = mail.split_mbox(raw)
    assert [n for n, _ in parts] == [0, 1]
    one, two = (mail.parse_message(m) for _, m in parts)
    assert (one["message_id"], one["subject"], one["body"], [a["name"] for a in one["attachments"]]) == ("<a@x>", "café", "hello", ["f.txt"])
    assert two["generated"] and two["body"] == "From here"


def test_addresses_and_participants():
    assert mail.split_addresses('"Last, First" <a@b.example>, c@d.example; (x, y) e@f.example') == ['"Last, First" <a@b.example>', "c@d.example", "(x, y) e@f.example"]
    assert mail.parse_address('"Last, First" <A@b.example>') == ("Last, First", "a@b.example")
    assert mail.parse_address("undisclosed recipients:") is None
    got = mail.participants({"from": "A <a@b.example>", "bcc": "broken, ok@x.example"})
    assert [(r, n, t) for r, n, t, *_ in got] == [("from", 0, "a@b.example"), ("bcc", 0, "ok@x.example")]
    assert mail.message_time("Mon, 01 Jan 2024 10:00:00 +0200") == "2024-01-01T08:00:00Z" and mail.message_time("soon") == ""


def test_texts_come_to_workers_in_small_pieces():
    import pyarrow as pa

    from lodestone.operators.common import in_pieces

    rows = ["x" * 1000, None, "", "y" * 5000, "é" * 300] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(rows, pa.string())], names=["id", "text"])
    pieces = list(in_pieces([batch, batch.slice(0, 0), batch.slice(7, 3)], 1, 10_000))
    assert [x for p in pieces for x in p.column(1).to_pylist()] == rows + rows[7:10]
    assert len(pieces) > 20 and all(sum(len(x or "") for x in p.column(1).to_pylist()) <= 16_000 for p in pieces)


def test_html_to_text():
    assert mail.html_to_text("<p>a&amp;b</p><script>no</script><div>c<br>d</div>") == "a&b c d"
    assert mail.html_to_text(None) == ""


def test_segments_cut_at_sentences_and_keep_ordinals():
    body = "Word and more words here. " * 100
    got = mail.segments([body])
    assert all(len(s) <= 1200 for _, s in got) and all(s.endswith(".") for _, s in got)
    assert mail.segments(["1 2 3"]) == [] and mail.segments([]) == []


def test_turtle():
    found, notes = rdf.parse('@prefix f: <http://f/> . # c\n<urn:a> a f:P ; f:n "x\\"y"@EN , "z"^^f:d .\n<urn:b> f:k [ f:x "in" ] , <urn:c> .\n<< <urn:a> f:n "z" >> <urn:end> "2004" .')
    assert [(s.subject.value, s.predicate, s.object.value) for s in found] == [("urn:a", rdf.RDF_TYPE, "http://f/P"), ("urn:a", "http://f/n", 'x"y'), ("urn:a", "http://f/n", "z"), ("urn:b", "http://f/k", "urn:c")]
    assert found[1].object.lang == "en" and found[2].object.datatype == "http://f/d"
    assert [(q.object.value, p, o.value) for q, p, o in notes] == [("z", "urn:end", "2004")]


def test_contact_readers():
    facts, rejected = cf.read_vcards("BEGIN:VCARD\nFN:Ann\\, B\nEMAIL:x@y.example\nEMAIL:junk\nNOTE;ENCODING=QUOTED-PRINTABLE:caf=C3=A9\nADR:;;1 Road;Town;;Z;Land\nEND:VCARD\nBEGIN:VCARD\nNOTE:nameless\nEND:VCARD\n")
    assert ("card-1", "name", "Ann, B") in facts and ("card-1", "note", "café") in facts and ("card-1", "address", "1 Road, Town, Z, Land") in facts
    assert not any(v == "junk" for *_, v in facts) and len(rejected) == 1
    assert cf.read_csv("﻿First Name,Last Name,Email\nA,B,C@D.example\n") == [("row-0", "email", "c@d.example"), ("row-0", "name", "A B")]
    with pytest.raises(ValueError):
        cf.read_csv("q,w\n1,2\n")
    ged = cf.read_gedcom("0 @I1@ INDI\n1 NAME Ann /Lee/\n0 @I2@ INDI\n1 NAME Bo\n0 @F1@ FAM\n1 WIFE @I1@\n1 CHIL @I2@\n")
    assert ("I1", "name", "Ann Lee") in ged and ("I2", "child_of", "I1") in ged
    bb = cf.read_bbdb(';; file\n["Ann" "Lee" nil ("Annie") ("Org") (["home" "555" "1234"]) nil ("A@b.example") nil nil]')
    assert {k for _, k, _ in bb} == {"name", "alias", "affiliation", "phone", "email"}
    plist = plistlib.dumps({"UID": "u", "First": "Ann", "Email": {"values": ["A@b.example"]}, "Organization": "Org"})
    assert ("u", "email", "a@b.example") in cf.read_address_book(plist)
    assert cf.decode("é".encode("utf-16")) == "é" and cf.decode(b"a\xff") == "a?"


def test_exports_round_trip():
    facts = [("name", "Ann; B", False), ("email", "a@b.example", False), ("email", "old@b.example", True), ("name", "Other", False)]
    card = cf.write_vcard("c1", facts)
    back, _ = cf.read_vcards(card)
    assert ("c1", "name", "Ann; B") in back and ("c1", "alias", "Other") in back and not any("old@" in v for *_, v in back)
    assert sorted(v for *_, v in cf.read_native(cf.write_native({"c1": facts}))) == sorted(v for _, v, _ in facts)
    assert len(rdf.parse(cf.write_turtle("urn:c1", facts))[0]) == 5


def slow_cuts(data):
    ends, start = [], 0
    gear = [int(g) for g in chunks.GEAR]
    while start < len(data):
        n = min(len(data) - start, chunks.MOST)
        cut, h = n, 0
        if len(data) - start > chunks.LEAST:
            for i in range(chunks.LEAST, n):
                h = (h * 2 + gear[data[start + i]]) % (1 << 64)
                if h & (chunks.MASK_BEFORE if i < min(chunks.USUAL, n) else chunks.MASK_AFTER) == 0:
                    cut = i
                    break
        start += cut
        ends.append(start)
    return ends


def test_chunks_match_a_byte_by_byte_walk():
    data = np.random.default_rng(3).integers(0, 256, 200_000, dtype=np.uint8)
    assert chunks.cut_points(data) == slow_cuts(data.tobytes())
    assert chunks.cut_points(data[:100]) == [100] and chunks.cut_points(data[:0]) == []


def claim(attr, value, kind, weight=1.0, **more):
    return resolve.Claim(attr, value, kind, weight, **more)


def test_id_diff_cases():
    same = resolve.id_diff([claim("email", "a", "set", 3)], [claim("email", "a", "set", 2)])
    assert same.score == 2 and same.anchored
    other = resolve.id_diff([claim("birth", "1", "functional", 5)], [claim("birth", "2", "functional", 5)])
    assert other.veto and other.score == -1.5 * 5
    replaced = resolve.id_diff([claim("birth", "1", "functional", 5, ulid="u")], [claim("birth", "2", "functional", 5, supersedes=("u",))])
    assert not replaced.veto and replaced.contradicting == 0
    apart = resolve.id_diff([claim("birth", "1", "functional", 5, until="2000")], [claim("birth", "2", "functional", 5, since="2001")])
    assert apart.contradicting == 0
    names = resolve.id_diff([claim("name", "ann", "name", 1), claim("name", "lee", "name", 2)], [claim("name", "ann", "name", 1), claim("name", "fox", "name", 3)])
    assert names.confirming == 0 and names.contradicting == 2
    initial = resolve.id_diff([claim("name", "a", "name", 1)], [claim("name", "ann", "name", 1)])
    assert initial.confirming == 1
    work = resolve.id_diff([claim("org", "x", "contextual", 0.2)], [claim("org", "x", "contextual", 0.2)], observation=True)
    assert work.score == 0
    assert resolve.omega("contextual", 9) == pytest.approx(0.2) and resolve.idf(10, 10) == 0 and resolve.idf(9, 1) == math.log(5)


def test_repair_keeps_cannot_link_pairs_apart():
    got = resolve.repair([("a", "b", 3), ("b", "c", 2), ("c", "d", 1), ("x", "y", 0.1)], [("a", "c")])
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_resolve_in_order():
    ann = [claim("email", "a", "set", 2), claim("name", "ann", "name", 1)]
    got = resolve.resolve_in_order([("o1", ann), ("o2", [claim("email", "a", "set", 2)]), ("o3", [claim("email", "b", "set", 2)]), ("o4", ann)])
    assert got == [("o1", "o1", "created"), ("o2", "o1", "merged"), ("o3", "o3", "created"), ("o4", "o1", "noop")]


def test_residual_basis_removes_shared_direction():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16)) * 0.05
    x[:, 0] += rng.standard_normal(600) * 5
    mean, basis = residual_basis(x, 1)
    assert abs(basis[0][0]) > 0.99 and residual_basis(x[:10], 1)[1].shape == (0, 16)


def test_breaker_and_backpressure():
    b = jobs.Breaker()
    for t in range(5):
        assert b.allow(t)
        b.record(False, t)
    assert not b.allow(10) and b.allow(20) and not b.allow(20)
    b.record(False, 20)
    assert not b.allow(49) and b.allow(50)
    b.record(True, 50)
    assert b.state == "closed"
    assert jobs.backpressure_states(np.array([1, 9, 6, 3, 6]), 8, 4).tolist() == [False, True, True, False, False]


def test_fixpoints_end_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",), ("y",)], "seed string")
    assert sorted(map(tuple, reachable(seeds, e).collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("y", "y")]
    assert {tuple(r) for r in smallest_reachable(e.selectExpr("source a", "target b")).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_sha_of_nul_joined_parts(spark):
    assert values(spark, ["b"], text.joined_hash(F.lit("a"), "x")) == [hashlib.sha256(b"a\0b").hexdigest()]


def test_cosine_pairs_and_clusters(spark):
    from lodestone.operators.discovery import cosine_pairs, discover, tfidf

    texts = ["apple pie recipe sugar", "apple pie recipe butter", "engine oil change motor", "motor engine oil filter", "lonely words here only", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    v = tfidf(docs)
    vectors = {}
    for r in v.collect():
        vectors.setdefault(r.id, {})[r.term] = r.w
    want = {(a, b) for a in vectors for b in vectors if a < b and sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) >= 0.3}
    assert {(r.a, r.b) for r in cosine_pairs(v, 0.3).collect()} == want and (0, 1) in want
    got = discover(docs, eps=0.7).collect()
    assert sorted(r["size"] for r in got) == [2, 2] and any("apple" in r.terms for r in got)


def test_messages(spark):
    from lodestone.functions import messages as m

    rows = ["@ann commented on it\nsee https://x.example/a/b/pull/12#c and https://y.example", "none"]
    assert values(spark, rows, m.review_link(F.col("x"))) == ["https://x.example/a/b/pull/12", ""]
    assert values(spark, rows, m.actor(F.col("x"))) == ["ann", ""]
    assert values(spark, ["joe\\40Home.xmpp@im.local", "a@b"], m.account_of(F.col("x"), "@im.local")) == ["joe@home.xmpp", ""]
    assert m.valid_summary("Short and new.", "Other source text") == (True, "")
    assert [m.valid_summary(*a)[1] for a in [("", ""), ("x" * 501, ""), ("- a\n- b\n- c\n- d", ""), ("the very same words " * 10, "the very same words " * 12)]] == ["empty", "too long", "too many bullets", "echoes its source"]
    assert m.guard_graph_query("MATCH (n) RETURN n", ["n agtype"]).endswith("LIMIT 100")
    for bad in ("CREATE (n) RETURN n", "MATCH (n) DELETE n", "MATCH (n) RETURN n; DROP x"):
        with pytest.raises(ValueError):
            m.guard_graph_query(bad, ["n"])
    with pytest.raises(ValueError):
        m.guard_graph_query("MATCH (n) RETURN n", ["n; drop"])


def test_search_text_is_cut_between_characters(spark):
    from lodestone.plans.projection import byte_prefix

    assert values(spark, ["abcé", "ab", "aéé"], byte_prefix(F.col("x"), 4)) == ["abc", "ab", "aé"]
