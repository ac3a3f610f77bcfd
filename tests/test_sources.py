"""Files on disk through Spark's readers."""

from lodestone.sources import files


def test_archive_of_files(spark, tmp_path):
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "a.mbox").write_bytes(b"From a\nMessage-ID: <1@x>\nSubject: s\n\none\n\nFrom b\nMessage-ID: <2@x>\n\n>From two\n")
    (tmp_path / "box" / "b.eml").write_bytes(b"Message-ID: <3@x>\n\nthree\n")
    (tmp_path / "tmp").mkdir()
    (tmp_path / "tmp" / "skipped.eml").write_bytes(b"Message-ID: <4@x>\n\nfour\n")
    found = files.files(spark, f"file://{tmp_path}")
    assert {r.media_type for r in found.collect()} == {"application/mbox", "message/rfc822"}
    got = {r.message_id: r.body for r in files.messages(files.archive_messages(found)).collect()}
    assert got == {"<1@x>": "one", "<2@x>": "From two", "<3@x>": "three"}


def test_contact_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Name,Email\nAnn,a@b.example\n")
    (tmp_path / "d.csv").write_text("q,w\n1,2\n")
    rows = files.contact_facts(files.files(spark, f"file://{tmp_path}"), "csv").collect()
    assert {(r.kind, r.value) for r in rows} == {("name", "Ann"), ("email", "a@b.example"), ("finding", "no known column in the header")}


def test_empty_folder_rows(spark, tmp_path):
    (tmp_path / "e.ttl").write_text("")
    assert files.rdf_rows(files.files(spark, f"file://{tmp_path}")).count() == 0
