import pytest

from tests.oracles import compare
from veriframe.llm.oracles import SQL
from veriframe.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    compare(QUERIES[name](spark, sf), SQL[name], sf)
