import pytest
from compare import differences

from guardmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    assert differences(found, queries.ORACLES[name], sf) is None
