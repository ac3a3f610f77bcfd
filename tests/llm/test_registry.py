"""The registered opN_ queries on the smallest tables; with SQL where there is any."""

import pytest
from oracle import connection, same

from lodestone.llm import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tiny, name):
    if "op10" in name:
        pytest.importorskip("public_tokenizers")
    df = registry.QUERIES[name](spark, tiny)
    if name in registry.SQL:
        same(df, connection(tiny), registry.SQL[name])
    else:
        assert df.count() == spark.read.parquet(f"{tiny}/{'pages' if 'warc' in name else 'documents'}.parquet").count()


def test_numbers_of_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
