import pytest
from cohortlab.llm.queries import QUERIES, SQL

from tests import oracle


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = oracle.rows(QUERIES[name](spark, sf))
    if name in SQL:
        assert got == oracle.sql_rows(oracle.tables(sf), SQL[name])
    else:
        assert got[0] and got[1]
