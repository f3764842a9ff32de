"""Every core query against its SQL twin on the smallest tables; the rest must run."""

import pytest
from cohortlab.plans import registry

from tests import oracle

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = oracle.rows(QUERIES[name](spark, sf))
    if name in SQL:
        assert got == oracle.sql_rows(oracle.tables(sf), SQL[name])
    else:
        assert got[0]


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
