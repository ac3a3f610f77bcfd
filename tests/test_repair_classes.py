"""Repair rounds by classes against the serial rule over all pairs."""

import pytest
import test_classes
from pyspark.sql import functions as F
from test_classes import CLAIMS, people
from test_repair import claim_rows, serial

from lodestone.operators import repair, resolve


@pytest.mark.parametrize("rows,threshold", [(claim_rows(21), 1.2), (test_classes.claim_rows(3, 60), resolve.GATE), (test_classes.claim_rows(6, 80, 5), 4.0)])
def test_rounds_by_classes_are_those_of_all_pairs(spark, monkeypatch, rows, threshold):
    """Sets of several values score differently the other way round, and components hold vetoes."""

    def near(classes_, k):
        e = classes_.select(F.col("entity").alias("a"))
        return e.join(e.withColumnRenamed("a", "b"), F.col("a") < F.col("b")), e.select(F.col("a").alias("entity"), F.col("a").alias("rep"))

    monkeypatch.setattr(repair, "near_pairs", near)
    rows = sorted({r[:3]: r for r in rows}.values())
    wanted, _ = serial(rows, threshold)
    got = {r.entity: r.cluster for r in repair.repaired(spark.createDataFrame(rows, CLAIMS), threshold).collect()}
    assert got == wanted and 1 < len(set(wanted.values())) < len(wanted)


def test_crowds_are_scored_by_classes(spark, monkeypatch):
    counts, write = [], repair.written

    def counted(df, label="step"):
        out = write(df, label)
        if label == "repair-scores":
            counts.append(out.count())
        return out

    monkeypatch.setattr(repair, "written", counted)
    got = repair.all_repaired(people(spark, persons=3, copies=150)).collect()
    assert len(got) == 450 and len({r.cluster for r in got}) == 3 + 450 // 3
    assert counts and max(counts) < 3000  # pairs of records: 11,000 and more, in parts of 64


def test_strong_identifiers_of_all_need_no_neighbours(spark):
    rows = [(f"e{i}", "account", f"a{i // 2}", "functional", "account") for i in range(200)] + [("x", "account", "a1", "functional", "account"), ("y", "account", "a150", "functional", "account")]
    c = spark.createDataFrame(rows, CLAIMS)
    assert repair.open_entities(c, resolve.idf_of(c)).count() == 0
    more = spark.createDataFrame([*rows, ("z", "name", "n", "name", "")], CLAIMS)
    assert repair.open_entities(more, resolve.idf_of(more)).count() == 203
    weak = spark.createDataFrame([(e, a, "a0" if int(v[1:]) < 60 else v, k, r) for e, a, v, k, r in rows], CLAIMS)
    got = {r.entity for r in repair.open_entities(weak, resolve.idf_of(weak)).collect()}
    assert got == {f"e{i}" for i in range(120)} | {"x"}
