import time
from fractions import Fraction
from math import comb, erfc, sqrt

import pytest
from pyspark.sql import functions as F

from veriframe.functions.numeric import two_sided_binomial


def slow_p(b, c):
    n, k = b + c, min(b, c)
    return float(min(Fraction(1), Fraction(2 * sum(comb(n, i) for i in range(k + 1)), 2**n)))


def test_p_equals_fractions_where_terms_are_few_and_many(spark):
    rows = [(b, c) for b in (0, 1, 2, 14, 15, 16, 17, 40, 500, 1000) for c in (0, 1, 15, 16, 17, 33, 480, 1000, 1100)]
    got = spark.createDataFrame(rows, "b long, c long").select("b", "c", two_sided_binomial(F.col("b"), F.col("c")).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["p"] == pytest.approx(slow_p(r["b"], r["c"]), rel=1e-11, abs=1e-300), r


def test_a_million_discordant_cases_take_no_square_of_steps(spark):
    start = time.monotonic()
    b, c = 500_000, 501_500
    p = spark.createDataFrame([(b, c)], "b long, c long").select(two_sided_binomial(F.col("b"), F.col("c")).alias("p")).first()["p"]
    assert time.monotonic() - start < 20
    assert p == pytest.approx(erfc((c - b - 1) / sqrt(b + c) / sqrt(2)), rel=1e-5)  # the normal tail with continuity
