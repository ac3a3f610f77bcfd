"""Full-text search over stored postings against the same search over texts; what its plan reads."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.common import web_search
from lodestone.operators.search import search
from lodestone.plans import stored
from lodestone.plans.views import Views

QUERIES = ["alpha beta", '"alpha beta"', '"beta alpha beta"', "alpha -beta", "-alpha", "gamma or delta -alpha", '-"alpha beta" gamma', '"alpha-beta"', "été or 42", "missing", "", "or", "-", '"" alpha', 'ALPHA "Beta gamma" -delta or "delta delta"']


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "Été", "42", "x_y", "beta."]
    rows = [(f"d{i}", " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(120)]
    rows += [("d0", rows[0][1]), ("empty", ""), ("none", None), ("long", "alpha " * 4000 + "beta")]
    return spark.createDataFrame(rows, "digest string, text string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('postings')}/p"
    stored.write_postings(texts, path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("query", QUERIES)
def test_postings_find_what_texts_hold(texts, index, query):
    wanted = {r.digest for r in texts.where(web_search(F.col("text"), query)).collect()}
    everything = texts.where("text is not null").select("digest").distinct()
    found = [r.digest for r in stored.matching(index, everything, query).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    if query in ("alpha beta", "-alpha"):
        assert wanted


def test_postings_are_kept_by_term(index):
    row = index.where("digest = 'long' and term = 'alpha'").first()
    assert row.positions == list(range(4000))
    assert index.select("bucket").distinct().count() > 2
    empty = stored.postings(index.select("digest", F.lit(None).cast("string").alias("text")))
    assert empty.count() == 0


def test_search_reads_no_text(spark, tiny):
    v = stored.stored(Views(spark, tiny))
    assert stored.stored(Views(spark, tiny)).base == v.base  # written once
    plan = v.matching('"of the" -and').where("true")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "documents.parquet" not in plan and "PushedFilters: [In(term" in plan
    page = search(v, text="the and", facets=["document"], limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in page and "conversations.parquet" not in page
    for name in stored.RELATIONS:
        assert getattr(v, name)().columns == getattr(Views(spark, tiny), name)().columns


def test_postings_move_no_rows_between_tasks(texts):
    plan = stored.postings(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_only_what_a_query_reads_is_written(spark, tiny, tmp_path):
    copy = tmp_path / "copy"
    copy.symlink_to(tiny)
    v = stored.stored(Views(spark, str(copy)))
    search(v, facets=["document"], limit=5).collect()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(v.base)
    names = {f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}
    assert names == {"query_objects", "query_facets"}


def test_analysis_joins_digests_not_texts(spark, tiny):
    plan = Views(spark, tiny).analysis()._jdf.queryExecution().optimizedPlan().toString()
    above = [a for a, b in itertools.pairwise(plan.splitlines()) if "Join Inner" in b]
    assert above and not any("sha2" in line for line in above)
