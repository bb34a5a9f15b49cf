"""The operators' registered queries against their SQL."""

import pytest

from curatrix.llm import queries
from tests.compare import connect, difference


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name]) is None
