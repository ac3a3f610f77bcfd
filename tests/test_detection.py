"""Formats of mail archives and dialects of contact tables, each by a fixture."""

import pytest

from lodestone.functions import contact_csv
from lodestone.sources import archive

MAIL = b"Received: x\r\nSubject: hello\r\n\r\nbody\r\n"
ARCHIVE = {
    "a/Maildir/cur/1699.M1.host:2,S": (MAIL, "maildir"),
    "a/Maildir/new/1700.M2.host": (MAIL, "maildir"),
    "a/Lone/cur/1701.host:2,": (MAIL, "maildir"),
    "a/Lone/cur/plain": (b"nothing\n", None),
    "a/inbox": (b"From someone Mon\nSubject: x\n\nbody\n", "mbox"),
    "a/inbox~": (b"From someone Mon\n", None),
    "a/inbox.old": (b"From someone Mon\n\n", None),
    "b/mh/1": (MAIL, "mh"),
    "b/mh/.mh_sequences": (b"unseen: 1", None),
    "b/nnml/12": (MAIL, "nnml"),
    "b/nnml/.overview": (b"12\thello", None),
    "b/numbers/7": (MAIL, "nnml"),
    "c/letter.EML": (b"", "eml-dir"),
    "c/letter.txt": (MAIL, "eml-dir"),
    "c/late.txt": (b"\n".join([b"x"] * 30) + b"\nSubject: late\n", None),
    "c/after": (b"text\n\nSubject: in the body\n", None),
    "c/.hidden.eml": (MAIL, None),
    "c/empty": (b"", None),
}


def test_formats_of_an_archive(spark):
    df = spark.createDataFrame([(f"file:/{p}", c) for p, (c, _) in ARCHIVE.items()], "path string, content binary")
    got = {r.path.removeprefix("file:/"): r.format for r in archive.detected(df).collect()}
    assert got == {p: f for p, (_, f) in ARCHIVE.items()}
    assert {r.format for r in archive.detected(df, "mbox").collect()} == {"mbox"}
    assert archive.detected(df.limit(0)).count() == 0


TABLES = {
    "linkedin-connections": ("Notes:\n\"a note\"\nFirst Name,Last Name,Email Address,Current Company,Connected On\nAnn,Bee,Ann@X.example,Works,2020\n", {("name", "Ann Bee"), ("email", "ann@x.example"), ("affiliation", "Works"), ("note", "2020")}),
    "linkedin-section": ("Skill Name\nKnitting\n", {("expertise", "Knitting")}),
    "google-contacts": ("Name,Given Name,Family Name,E-mail 1 - Value,Birthday\nAnn Bee,Ann,Bee,a@x.example,1990\n", {("name", "Ann Bee"), ("email", "a@x.example"), ("birthday", "1990")}),
    "outlook-contacts": ("First Name;Last Name;E-mail Address;Business Street\nAnn;Bee;a@x.example;Road 1\n", {("name", "Ann Bee"), ("email", "a@x.example"), ("address", "Road 1")}),
    "yahoo-contacts": ("First\tLast\tEmail\tMobile\nAnn\tBee\ta@x.example\t555\n", {("name", "Ann Bee"), ("email", "a@x.example"), ("phone", "555")}),
    "simple-name-email": ("﻿First Name,Last Name,Email\n,Bee,a@x.example\n", {("name", "Bee"), ("email", "a@x.example")}),
}


@pytest.mark.parametrize("dialect", TABLES)
def test_dialects(dialect):
    text, facts = TABLES[dialect]
    got = contact_csv.read_dialect(text)
    assert got[0] == ("", "dialect", dialect) and {(k, v) for r, k, v in got if r} == facts


def test_rejections_and_overrides():
    text = "First Name,Last Name,Email,Shoe Size,Company\nAnn,Bee,a@x.example,39,Works\n,,,40,Works\n,,,,\n"
    got = contact_csv.read_dialect(text)
    assert ("", "unmapped", "Shoe Size") in got and ("row-1", "rejected", "no contact identity") in got and not any(r == "row-2" for r, _, _ in got)
    got = contact_csv.read_dialect(text, {"Shoe  size": "size", "company": ""})
    assert ("row-0", "size", "39") in got and not any(k in ("unmapped", "affiliation") for _, k, _ in got)
    assert contact_csv.read_dialect("Who,Where\nAnn,here\n", {"Who": "name", "where": "address"}) == [("", "dialect", "custom"), ("row-0", "name", "Ann"), ("row-0", "address", "here")]
    with pytest.raises(ValueError, match="no known dialect"):
        contact_csv.read_dialect("q,w\n1,2\n")
