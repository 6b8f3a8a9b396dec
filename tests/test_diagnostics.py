"""Diagnostics against brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.operators import diagnostics, learned, metrics


def f1(y, p):
    half = lambda c: 2 * np.sum((y == c) & (p == c)) / max(1, np.sum(y == c) + np.sum(p == c))
    return (half(0) + half(1)) / 2


def test_running_sums_over_ranges_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(s), int(rng.integers(1, 9))) for k in ("a", "b", None) for s in rng.permutation(500)[:300]]
    got = {(r["k"], r["s"]): r["below_n"] for r in metrics.below(spark.createDataFrame(rows, "k string, s double, n int"), "s", ["n"], ["k"]).collect()}
    assert got == {(k, s): sum(n for kk, ss, n in rows if kk == k and ss < s) for k, s, _ in rows}
    empty = metrics.below(spark.createDataFrame([], "s double, n int"), "s", ["n"])
    assert empty.collect() == []


def test_curves_with_ties_nulls_and_one_class(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.2, 0), (0.9, 1)], "s double, y int")
    assert metrics.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(0.875)
    assert [(r["s"], r["flagged"], r["hits"]) for r in metrics.precision_recall(df, "s", "y").orderBy(F.desc("s")).collect()] == [(0.9, 1, 1), (0.5, 3, 2), (0.2, 4, 2)]
    assert metrics.roc_auc(df.where("y = 1"), "s", "y").first()["auc"] is None
    assert metrics.precision_recall(df.limit(0), "s", "y").collect() == []


def test_judge_axes_of_one_class_and_missing_values(spark):
    df = spark.createDataFrame([(1, 0.995, 1, 0.2), (1, 0.4, 0, 0.1), (None, 0.3, 1, None)], "f int, pf double, r int, pr double")
    rows = {r["axis"]: r for r in diagnostics.judge_axes(df, {"faith": ("f", "pf"), "rel": ("r", "pr")}).collect()}
    assert rows["faith"]["auc"] == 0.5 and rows["faith"]["sure_share"] == 0.5 and rows["faith"]["unreliable_recall"] == 0
    assert rows["rel"]["n"] == 2 and rows["rel"]["auc"] == 1 and rows["rel"]["n_fail"] == 2 and rows["rel"]["unreliable_recall"] == 1


def test_held_out_thresholds_are_the_best_grid_points(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    rows = [(str(i), int(v), float(v + rng.normal()), float(rng.normal())) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "id string, y int, a double, b double")
    judged, fitted = diagnostics.held_out_heads(df, F.col("id").cast("int") < 200, ("a", "b"), ("y",))
    held = judged.collect()
    assert sorted(int(r["id"]) for r in held) == list(range(200, 300))
    ys, ps = np.array([r["y"] for r in held]), np.array([r["p"] for r in held])
    want = max((round(f1(ys, (ps >= i * 0.01).astype(int)), 12), -i) for i in range(5, 96))
    got = fitted.first()
    assert (got["macro_f1"], got["threshold"]) == pytest.approx((want[0], -want[1] * 0.01))
    flipped = df.withColumn("y", F.when(F.col("id").cast("int") < 200, F.col("y")).otherwise(1 - F.col("y")))
    again = {r["id"]: r["p"] for r in diagnostics.held_out_heads(flipped, F.col("id").cast("int") < 200, ("a", "b"), ("y",))[0].collect()}
    assert again == pytest.approx({r["id"]: r["p"] for r in held})


def test_increments_keep_what_helps(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    rows = [(str(i), int(v), float(rng.normal()), float(2 * v + rng.normal()), float(rng.normal())) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "id string, y int, base double, good double, noise double")
    folds = df.select("id", F.lit(0).alias("repeat"), (F.col("id").cast("int") % 4).alias("fold"))
    table = diagnostics.increments(df, folds, ("base",), ("good", "noise"), "y", b=500)
    assert {r["feature"] for r in learned.kept_by_interval(table).collect()} == {"good"}


def test_memoriser_equals_a_loop_over_copies(spark):
    rng = np.random.default_rng(7)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(8))
    texts = [text() for _ in range(12)] * 4 + [None] * 6
    rows = [(f"{i:03}", t, int(rng.integers(0, 2))) for i, t in enumerate(texts)]
    fold = rng.integers(0, 3, len(rows))
    df = spark.createDataFrame(rows, "id string, t string, y int")
    folds = spark.createDataFrame([(r[0], 0, int(k)) for r, k in zip(rows, fold, strict=True)], "id string, repeat int, fold int")
    y, p, matched = np.array([r[2] for r in rows]), [], 0
    for i, (_, t, _) in enumerate(rows):
        train = [j for j in range(len(rows)) if fold[j] != fold[i]]
        same = [j for j in train if t is not None and rows[j][1] == t]
        matched += bool(same)
        p.append(rows[same[0]][2] if same else int(2 * sum(y[train]) >= len(train)))
    got = diagnostics.memoriser(df, folds, F.col("t"), "y", 0.9).first()
    assert (got["n"], got["n_matched"]) == (len(rows), matched) and got["macro_f1"] == pytest.approx(f1(y, np.array(p)))
