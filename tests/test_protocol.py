"""Rules of comparison find what is put wrong and let pass what is right."""

import pytest
from pyspark.sql import functions as F

from veriframe.operators import protocol, thresholds


def test_broken_folds_raise(spark):
    good = [(f"c{i}", r, (i + r) % 3) for i in range(12) for r in range(2)]
    table = lambda rows: spark.createDataFrame(rows, "id string, repeat int, fold int")
    protocol.require_isolated(table(good), 3)
    for bad, reason in (([*good, ("c1", 0, 0)], "several folds"), ([*good, ("x", 0, 3)], "no such fold"), ([*good, ("x", 0, None)], "no such fold"), ([(i, 0, 1) for i, r, _ in good if r], "fewer than two")):
        with pytest.raises(ValueError, match=reason):
            protocol.require_isolated(table(bad), 3)


def test_thresholds_that_are_not_the_best_raise(spark):
    df = spark.createDataFrame([(f"c{i}", int(i % 10 > 5), (i % 10) / 10) for i in range(60)], "id string, y int, s double")
    folds = df.select("id", F.lit(0).alias("repeat"), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("fold"))
    used = thresholds.fold_thresholds(df, folds, "y", "s")
    protocol.require_train_optimal(df, folds, used, "y", "s")
    for bad in (used.withColumn("threshold", F.lit(0.0)), used.withColumn("threshold", F.lit(0.123456)), used.where("fold > 0")):
        with pytest.raises(ValueError, match="best of its training rows"):
            protocol.require_train_optimal(df, folds, bad, "y", "s")


def test_runs_of_other_gold_or_corpus_raise(spark):
    run = lambda rows: spark.createDataFrame(rows, "id string, y int, s double")
    a, b = run([("a", 1, 0.5), ("b", None, 0.1), ("only", 0, 0.2)]), run([("a", 1, 0.7), ("b", None, 0.2), ("other", 1, 0.9)])
    assert sorted((r["id"], r["s"], r["other_s"]) for r in protocol.paired(a, b).collect()) == [("a", 0.5, 0.7), ("b", 0.1, 0.2)]
    with pytest.raises(Exception, match="labels differ between runs: a"):
        protocol.paired(a, run([("a", 0, 0.7)])).collect()
    known = tuple(protocol.fingerprint(a).first())
    protocol.require_same_corpus(a, *known)
    with pytest.raises(ValueError, match="another corpus"):
        protocol.require_same_corpus(b, *known)


def test_marker_of_the_failing_axis(spark):
    rows = [(0.4, 0.3, ["x"], ["y", "z", "z"], "z"), (0.3, 0.3, ["b", "a", "", None], ["y"], "b"), (0.9, 0.2, ["x"], [None, ""], "unknown"), (0.6, 0.5, ["x"], ["y"], "none")]
    df = spark.createDataFrame(rows, "f double, r double, fm array<string>, rm array<string>, want string")
    for r in df.withColumn("got", protocol.pick_marker(F.col("f"), F.col("r"), F.col("fm"), F.col("rm"))).collect():
        assert r["got"] == r["want"]
