import random

import numpy as np
import pytest

from veriframe.operators import thresholds


def f1(tn, fp, fn, tp):
    half = lambda a, b: 2 * a / (2 * a + b) if 2 * a + b else 0.0
    return (half(tn, fp + fn) + half(tp, fp + fn)) / 2


def slow_entropy(rows, steps):
    """All thresholds, one by one; (t_contra, t_entropy, t_rel, macro_f1)."""
    grid = [i * (1 / steps) for i in range(steps)] + [1.0]
    seen = sorted({e for *_, e in rows if e is not None and e == e}) + [float("inf")]
    best = None
    for tc in grid:
        for te in seen:
            for tr in grid:
                n = [[0, 0], [0, 0]]
                for y, c, r, e in rows:
                    n[y][c <= tc and e is not None and e <= te and r >= tr] += 1
                value = f1(n[0][0], n[0][1], n[1][0], n[1][1])
                if best is None or value > best[3] + 1e-15:
                    best = (tc, te, tr, value)
    return best


@pytest.mark.parametrize("seed,size", [(0, 100_000), (1, 5), (2, 20), (3, 3)])
def test_entropy_sweep_equals_all_thresholds(spark, monkeypatch, seed, size):
    monkeypatch.setattr(thresholds, "RANGE_CELLS", size)
    rng = random.Random(seed)
    some = lambda: rng.choice([rng.random(), 0.0, 1.0, 0.1 * rng.randint(0, 10), rng.choice([-0.2, 1.3])])
    rows = [(int(rng.random() < 0.5), some(), some(), rng.choice([rng.random(), 0.5, 0.25, None if seed else 0.1, float("inf")])) for _ in range(70)]
    got = thresholds.fit_with_entropy(spark.createDataFrame(rows, "y int, c double, r double, e double"), "y", "c", "r", "e", steps=6).first()
    assert tuple(got) == pytest.approx(slow_entropy(rows, 6))
    plain = thresholds.fit_with_entropy(spark.createDataFrame(rows, "y int, c double, r double, e double"), "y", "c", "r", steps=6).first()
    want = slow_entropy([(y, c, r, 0.0) for y, c, r, _ in rows], 6)
    assert plain["t_entropy"] is None and (plain["t_contra"], plain["t_rel"], plain["macro_f1"]) == pytest.approx((want[0], want[2], want[3]))


def test_entropy_sweep_of_nothing(spark):
    none = spark.createDataFrame([], "y int, c double, r double, e double")
    assert tuple(thresholds.fit_with_entropy(none, "y", "c", "r", "e", steps=4).first()) == (0.0, float("inf"), 0.0, 0.0)
    never = spark.createDataFrame([(1, 0.1, 0.9, None), (0, 0.1, 0.9, float("nan"))], "y int, c double, r double, e double")
    assert tuple(thresholds.fit_with_entropy(never, "y", "c", "r", "e", steps=4).first()) == pytest.approx((0.0, float("inf"), 0.0, 1 / 3))


def test_many_distinct_entropies_make_no_grid_of_their_own(spark):
    rows = spark.range(40_000).selectExpr("cast(id % 2 as int) y", "(id % 101) / 100.0D c", "(id % 89) / 88.0D r", "id / 7.0D e")
    got = thresholds.fit_with_entropy(rows, "y", "c", "r", "e").first()
    assert 0 < got["macro_f1"] < 1


def test_drawn_noise_has_the_distribution_of_noise_case_by_case(spark):
    rng, n, trials = np.random.default_rng(6), 90, 1500
    y = (rng.random(n) < 0.35).astype(int)
    fold = rng.integers(0, 3, (n, 2))
    df = spark.createDataFrame([(str(i), int(y[i])) for i in range(n)] + [("unplaced", 1), ("unlabelled", None)], "id string, y int")
    folds = spark.createDataFrame([(str(i), r, int(fold[i, r])) for i in range(n) for r in range(2)] + [("unlabelled", 0, 1)], "id string, repeat int, fold int")
    drawn = sorted(r["macro_f1"] for r in thresholds.null_distribution_drawn(df, folds, "y", trials, steps=20).collect())
    by_case = sorted(r["macro_f1"] for r in thresholds.null_distribution(df.where("y is not null"), folds, "y", trials, steps=20).collect())
    assert len(drawn) == len(by_case) == trials
    points = np.linspace(min(drawn[0], by_case[0]), max(drawn[-1], by_case[-1]), 400)
    apart = np.abs(np.searchsorted(drawn, points, "right") - np.searchsorted(by_case, points, "right")).max() / trials
    assert apart < 1.63 * (2 / trials) ** 0.5  # Kolmogorov and Smirnov, 1 %
    again = sorted(r["macro_f1"] for r in thresholds.null_distribution_drawn(df, folds.repartition(3), "y", trials, steps=20).collect())
    assert again == drawn
    assert thresholds.null_distribution_drawn(df.limit(0), folds, "y", 5).count() == 0


def test_drawn_noise_costs_the_same_for_any_number_of_cases(spark, monkeypatch):
    cases = spark.range(300_000).selectExpr("cast(id as string) id", "cast(id % 3 = 0 as int) y")
    folds = spark.range(300_000).selectExpr("cast(id as string) id", "0 repeat", "cast(id % 5 as int) fold")
    found = thresholds.null_distribution_drawn(cases, folds, "y", 4).collect()
    assert len(found) == 4 and all(0.2 < r["macro_f1"] < 0.6 for r in found)
    monkeypatch.setattr(thresholds, "MOST_CELLS", 3)
    with pytest.raises(ValueError, match="combinations"):
        thresholds.null_distribution_drawn(cases, folds, "y", 4)
