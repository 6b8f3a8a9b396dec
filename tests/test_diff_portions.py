import pytest
from pyspark.sql import functions as F

from veriframe.operators import diffs


@pytest.mark.parametrize("chars", [1, 40, 10**6])
def test_diffs_leave_in_portions_and_in_order(spark, monkeypatch, chars):
    monkeypatch.setattr(diffs, "CHARS", chars)
    rows = [(i, None if i % 7 == 0 else "\n".join(f"l{j % 5}" for j in range(i % 13)), f"l1\nl{i % 4}\nx{i}") for i in range(60)]
    got = diffs.line_diff(spark.createDataFrame(rows, "id long, a string, b string").repartition(2), F.col("a"), F.col("b")).collect()
    want = {i: diffs.hunks(a, b) for i, a, b in rows}
    assert {r["id"]: (r["diff"]["removed"], r["diff"]["added"], r["diff"]["hunks"]) for r in got} == want and len(got) == 60
