"""Valid times of facts from annotated statements in RDF-star text."""

from pyspark.sql import functions as F

from lodestone.functions import rdf
from lodestone.functions import vocabulary as vo
from lodestone.operators import knowledge

TEXT = f"""
@prefix foaf: <{vo.iri('foaf:')}> .
<contact:a> a <{vo.iri('foaf:Person')}> ; foaf:mbox <mailto:A@x.example>, <mailto:b@x.example> ; foaf:name "Ann" .
<< <contact:a> foaf:mbox <mailto:A@x.example> >> <{vo.iri('own:validFrom')}> "1999" ; <{vo.iri('own:validUntil')}> "2005" .
<< <contact:a> foaf:mbox <mailto:A@x.example> >> <{vo.iri('own:validFrom')}> "2001" .
<< <contact:a> foaf:name "Ann" >> <{vo.iri('time:hasEnd')}> "2020" .
<< <contact:a> foaf:name "Other" >> <{vo.iri('own:validFrom')}> "1900" .
<< <contact:a> foaf:mbox <mailto:b@x.example> >> <{vo.iri('own:displayable')}> "1" .
"""


def test_annotated_statements(spark):
    found, notes = rdf.parse(TEXT)
    s = spark.createDataFrame([(src, x.subject.value, x.predicate, x.object.value, x.object.kind) for src in ("one", "two") for x in found], "source string, subject string, predicate string, object string, object_kind string")
    n = spark.createDataFrame([("one", q.subject.value, q.predicate, q.object.value, i, p, o.value) for i, (q, p, o) in enumerate(notes)], "source string, subject string, predicate string, object string, ord int, note string, note_value string")
    contacts = s.select("source", F.col("subject").alias("contact")).distinct()
    got = {(r.kind, r.value): (r.source, r.valid_from, r.valid_until) for r in knowledge.timed_facts(s, contacts, n).collect()}
    # what two sources say alike is one fact, with the times that one of them states; of two begins the last counts
    assert got[("email", "a@x.example")] == ("one", "2001", "2005")
    assert got[("name", "Ann")] == ("one", "", "2020")
    assert got[("email", "b@x.example")][1:] == ("", "")
    assert ("name", "Other") not in got
    bare = {(r.kind, r.value): (r.valid_from, r.valid_until) for r in knowledge.timed_facts(s, contacts, n.limit(0)).collect()}
    assert set(bare) == set(got) and set(bare.values()) == {("", "")}
