"""Every registered query of the library against its SQL on the smallest tables; those without SQL must run."""

import pytest
from oracle import connection, same

from lodestone import registry


@pytest.fixture(scope="module")
def con(tiny):
    return connection(tiny)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tiny, con, name):
    df = registry.QUERIES[name](spark, tiny)
    if name in registry.SQL:
        same(df, con, registry.SQL[name])
    else:
        assert df.count() >= 0


def test_sql_names_are_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
