import pytest
from oracle import compare

from thawline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])
