"""Queries do the whole job of their operator, held against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from veriframe.operators import groups, inference, thresholds
from veriframe.plans import metric_queries, more_queries, views


def f1(y, p):
    half = lambda c: 2 * np.sum((y == c) & (p == c)) / max(1, np.sum(y == c) + np.sum(p == c))
    return (half(0) + half(1)) / 2


def test_null_distribution_has_all_trials_and_repeats(spark, sf):
    assert views.N_REPEATS == 5 and metric_queries.TRIALS == 500
    assert sorted(r["trial"] for r in entry_points.queries()["k15_null_calibration"](spark, sf).select("trial").collect()) == list(range(500))
    assert {r["repeat"] for r in views.folds(spark, sf).select("repeat").distinct().collect()} == set(range(5))


def test_null_distribution_equals_a_loop_over_trials(spark):
    rng, n, trials = np.random.default_rng(5), 40, 53
    y, fold = rng.integers(0, 2, n), rng.integers(0, 3, (n, 2))
    df = spark.createDataFrame([(str(i), int(y[i])) for i in range(n)], "id string, y int")
    folds = spark.createDataFrame([(str(i), r, int(fold[i, r])) for i in range(n) for r in range(2)], "id string, repeat int, fold int")
    got = {r["trial"]: r["macro_f1"] for r in thresholds.null_distribution(df, folds, "y", trials).collect()}
    grid = [i * 0.01 for i in range(100)] + [1.0]
    want = {}
    for t in range(trials):
        s = np.array([int(hashlib.md5(f"{t}:{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(n)])
        each = []
        for r in range(2):
            p = np.zeros(n, int)
            for k in range(3):
                train = fold[:, r] != k
                best = max(grid, key=lambda g: (round(f1(y[train], (s[train] >= g).astype(int)), 12), -g))
                p[~train] = s[~train] >= best
            each.append(f1(y, p))
        want[t] = np.mean(each)
    assert got == pytest.approx(want)


def test_seeded_bootstrap_draws_ten_thousand(spark, sf, monkeypatch):
    drawn = []
    plain = inference.draws
    monkeypatch.setattr(inference, "draws", lambda counts, s, b, *rest: drawn.append(b) or plain(counts, s, b, *rest))
    entry_points.queries()["k13_seeded_bootstrap"](spark, sf).collect()
    assert drawn == [10_000]


def test_entropy_thresholds_are_the_best_of_the_whole_grid(spark, sf):
    rows = more_queries.entropies(spark, sf).collect()
    y, contra, rel, entropy = (np.array([r[c] for r in rows]) for c in ("y", "contra", "rel", "entropy"))
    grid, best = [i * 0.01 for i in range(100)] + [1.0], (-1.0,)
    high = rel[None, :] >= np.array(grid)[:, None]
    for a in grid:
        for e in sorted({*entropy.tolist(), np.inf}):
            p = high & (contra <= a) & (entropy <= e)
            tp, fp = (p & (y == 1)).sum(1), (p & (y == 0)).sum(1)
            fn, tn = (y == 1).sum() - tp, (y == 0).sum() - fp
            half = lambda x: np.where(2 * x + fp + fn == 0, 0.0, 2 * x / np.maximum(1, 2 * x + fp + fn))  # noqa: E731, B023
            scores = (half(tn) + half(tp)) / 2
            k = int(np.argmax(scores))
            if scores[k] > best[0] + 1e-12:
                best = (scores[k], a, e, grid[k])
    got = entry_points.queries()["k05_entropy_thresholds"](spark, sf).first()
    assert (got["macro_f1"], got["t_contra"], got["t_entropy"], got["t_rel"]) == pytest.approx(best)


def near_cases(spark):
    """Pairs of questions that differ in one late letter, far apart from pair to pair."""
    rng = np.random.default_rng(8)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(20))
    rows = [(f"{i:02}{x}", q + x, f"chunk {i}{x}", i % 2) for i, q in enumerate(text() for _ in range(20)) for x in "xy"]
    return spark.createDataFrame(rows, "id string, q string, ch string, y int")


def test_near_questions_split_between_folds_are_an_error(spark):
    cases = near_cases(spark)
    q, ch = F.col("q"), F.col("ch")
    reduced = groups.build_groups(cases, q, ch, near=None)
    folds = cases.select("id", F.lit(0).alias("repeat"), F.when((F.substring("id", 1, 2).cast("int") < 3) & F.endswith("id", F.lit("y")), 1).otherwise(0).alias("fold"))
    check = lambda f, g, **k: {tuple(r) for r in groups.check_folds(cases, f, g, "y", 2, 1.0, 9.0, query=q, chunk=ch, **k).collect()}
    assert check(folds, reduced) == {("error", "near-duplicate leak: 0.15")}
    whole = groups.build_groups(cases, q, ch)
    assert whole.select("grp").distinct().count() == 20
    assert check(groups.assign_folds(cases, whole, "y", 2, 2), whole) == set()


def test_shared_queries_and_first_chunks_over_folds(spark):
    cases = spark.createDataFrame([(str(i), f"question number {i // 2}", f"c{i % 5}", 1) for i in range(10)], "id string, q string, ch string, y int")
    own = cases.select("id", F.col("id").alias("grp"))
    folds = cases.select("id", F.lit(0).alias("repeat"), (F.col("id") == "3").cast("int").alias("fold"))
    found = {tuple(r) for r in groups.check_folds(cases, folds, own, "y", 2, 1.0, 9.0, query=F.col("q"), chunk=F.col("ch"), near=None).collect()}
    assert found == {("error", "query leak: 0.2"), ("warning", "first chunk leak: 0.2")}


def test_fold_queries_keep_near_questions_together(spark, sf):
    placed = {}
    for r in entry_points.queries()["k06_folds"](spark, sf).collect():
        placed.setdefault(r["repeat"], {})[r["id"]] = r["fold"]
    assert len(placed) == 5
    pairs = [(r["a"], r["b"]) for r in entry_points.queries()["j06_near_pairs"](spark, sf).collect()]
    assert all(f[a] == f[b] for f in placed.values() for a, b in pairs if a in f and b in f)
    assert not [r for r in entry_points.queries()["k07_fold_check"](spark, sf).collect() if "leak" in r["what"]]


def test_parts_of_a_method_do_not_bear_its_id():
    names = entry_points.queries().keys()
    assert {"m01_scores_auc", "k08_report"} <= names
    assert {n for n in names if n.startswith(("m03_", "k16_"))} == {"m03_stack", "m03_stack_auc", "k16_report", "k16_report_points"}  # the whole ones
