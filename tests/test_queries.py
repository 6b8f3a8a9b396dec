import pytest

import __spark_entry__ as entry_points

from .oracles import compare

SQL = entry_points.oracle_sql()
OWN = [n for n in entry_points.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf, name):
    df = entry_points.queries()[name](spark, sf)
    if name in SQL:
        compare(df, SQL[name], sf)
    else:
        df.collect()


def test_every_sql_has_a_query_and_entry_runs(spark):
    assert set(SQL) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
