"""Every query of the library over the smallest data, against its SQL."""

import pytest

from tickloom import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data, rows_of):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got.columns) == len(set(got.columns))


def test_sql_is_only_for_known_queries():
    assert set(ORACLE) <= set(QUERIES)
