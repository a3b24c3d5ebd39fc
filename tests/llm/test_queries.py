"""Queries of this subpackage against their SQL."""

import pytest

from spanlab.llm import queries
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        assert_same(df, SF, queries.ORACLE_SQL[name])
    else:
        assert df.count() > 0
