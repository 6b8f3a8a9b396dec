import math
import random
from collections import defaultdict

import numpy as np
import pytest

from veriframe.operators import stacking


def slow_head(x, y, c):
    """Scaled, balanced, penalised logistic regression by plain Newton steps; (weights, intercept) for raw features."""
    x, y = np.array(x, float), np.array(y, float)
    if len(set(y)) < 2:
        return np.zeros(x.shape[1]), math.copysign(stacking.EDGE, y[0] - 0.5)
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w = c * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ b)
    return b[:-1] / std, b[-1] - (b[:-1] / std) @ mean


def slow_area(z, y):
    bins = [min(stacking.BINS - 1, max(0, int((v + stacking.EDGE) * stacking.BINS / (2 * stacking.EDGE)))) for v in z]
    pos, neg = [b for b, t in zip(bins, y, strict=True) if t], [b for b, t in zip(bins, y, strict=True) if not t]
    return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) if pos and neg else None


def slow_isotonic(z, y):
    """Least squares by definition: max over starts of min over ends of means."""
    xs = sorted(set(z))
    n = [sum(v == x for v in z) for x in xs]
    s = [sum(t for v, t in zip(z, y, strict=True) if v == x) for x in xs]
    mean = lambda a, b: sum(s[a : b + 1]) / sum(n[a : b + 1])
    fit = [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    return lambda v: np.interp(v, xs, fit)


def slow_sigmoid(z, y):
    z, y = np.array(z), np.array(y)
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, design, b = np.where(y == 1, up, down), np.column_stack([z, np.ones(len(z))]), np.zeros(2)
    loss = lambda b: np.logaddexp(0, design @ b).sum() - t @ (design @ b)
    for _ in range(300):
        p = 1 / (1 + np.exp(-design @ b))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-12 * np.eye(2), design.T @ (p - t))
        size = 1.0
        while loss(b - size * step) > loss(b) + 1e-15 and size > 1e-6:
            size /= 2
        b = b - size * step
    return lambda v: 1 / (1 + np.exp(-(b[0] * np.asarray(v) + b[1])))


def slow_stack(rows, calibrate):
    """{id: p} from cells (id, repeat, fold, part, inner, y, x), each model fitted by itself."""
    sums, times = defaultdict(float), defaultdict(int)
    pick = lambda keep: [r for r in rows if keep(r)]
    for repeat, fold in sorted({(r["repeat"], r["fold"]) for r in rows}):
        train = pick(lambda r: r["repeat"] == repeat and r["fold"] != fold)
        test = pick(lambda r: r["repeat"] == repeat and r["fold"] == fold)
        curves = []
        for part in range(stacking.PARTS):
            own, judged = [r for r in train if r["part"] != part], [r for r in train if r["part"] == part]
            areas = []
            for c in stacking.STRENGTHS:
                each = []
                for inner in range(stacking.PARTS):
                    fit_on, on = [r for r in own if r["inner"] != inner], [r for r in own if r["inner"] == inner]
                    w, b = slow_head([r["x"] for r in fit_on], [r["y"] for r in fit_on], c)
                    area = slow_area([w @ np.array(r["x"]) + b for r in on], [r["y"] for r in on])
                    each += [area] if area is not None else []
                areas.append(np.mean(each) if each else 0.5)
            w, b = slow_head([r["x"] for r in own], [r["y"] for r in own], stacking.STRENGTHS[int(np.argmax(areas))])
            z = lambda r, w=w, b=b: w @ np.array(r["x"]) + b
            how = calibrate if calibrate != "auto" else "isotonic" if len(train) >= stacking.ISOTONIC_FROM else "sigmoid"
            curve = (slow_isotonic if how == "isotonic" else slow_sigmoid)([z(r) for r in judged], [r["y"] for r in judged])
            curves.append((z, curve))
        for r in test:
            sums[r["id"]] += np.mean([curve(z(r)) for z, curve in curves])
            times[r["id"]] += 1
    return {i: sums[i] / times[i] for i in sums}


def corpus(spark, n, repeats, folds, seed, shift=0.0):
    rng = random.Random(seed)
    rows, placed = [], []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append((f"c{i}", y, shift + round(rng.gauss(0.8 * y, 1), 2), rng.choice([0.0, 1.0, 2.0]) + y, 7.0))
        placed += [(f"c{i}", r, rng.randrange(folds)) for r in range(repeats)]
    return spark.createDataFrame(rows, "id string, y int, a double, b double, constant double"), spark.createDataFrame(placed, "id string, repeat int, fold int")


@pytest.mark.parametrize("calibrate,shift", [("isotonic", 0.0), ("sigmoid", 0.0), ("auto", 1e6)])
def test_equals_models_fitted_one_by_one(spark, monkeypatch, calibrate, shift):
    monkeypatch.setattr(stacking, "RANGE_ROWS", 7)  # several ranges
    monkeypatch.setattr(stacking, "ISOTONIC_FROM", 95)
    cases, folds = corpus(spark, 140, 1, 3, 1, shift)
    features = ("a", "b", "constant")
    rows = [r.asDict() for r in stacking.celled(cases, folds, features, "y").collect()]
    want = slow_stack([{**r, "x": [r["x"][0] - shift, *r["x"][1:]]} for r in rows], calibrate)
    got = {r["id"]: r["p"] for r in stacking.stacked(cases, folds, features, "y", calibrate).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6
    again = {r["id"]: r["p"] for r in stacking.stacked(cases.orderBy("a"), folds.repartition(3), features, "y", calibrate).collect()}
    assert max(abs(got[i] - again[i]) for i in got) < 1e-9


def test_ranges_give_the_isotonic_regression_of_all(spark, monkeypatch):
    rng = random.Random(5)
    data = {h: [(round(rng.gauss(0, 1), d), int(rng.random() < 0.3 + 0.2 * h)) for _ in range(n)] for h, (n, d) in enumerate(((300, 2), (40, 0), (1, 1), (120, 6)))}
    data[1] = [(z, 1) for z, _ in data[1]]  # one class
    counts = spark.createDataFrame([(h, z, 1, y) for h, v in data.items() for z, y in v], "head int, z double, n long, pos long").groupBy("head", "z").sum("n", "pos").toDF("head", "z", "n", "pos")
    asked = [(h, z, f"{h}:{z}") for h in data for z in [-9.0, -0.333, 0.0, 0.005, 0.5, 1.0001, 9.0, *[z for z, _ in data[h]][:30]]]
    for size in (1, 9, 10**6):
        monkeypatch.setattr(stacking, "RANGE_ROWS", size)
        blocks, cuts = stacking.isotonic(counts)
        assert max(map(len, cuts.values())) > 5 if size < 10 else not any(cuts.values())
        got = stacking.interpolated(spark.createDataFrame(asked, "head int, z double, name string"), blocks, cuts).collect()
        assert len(got) == len(asked)
        curves = {h: slow_isotonic(*zip(*v, strict=True)) for h, v in data.items()}
        for r in got:
            assert r["p"] == pytest.approx(float(curves[r["head"]](r["z"])), abs=1e-12), (size, r)


def test_parts_are_even_in_every_fold_and_label(spark):
    cases, folds = corpus(spark, 200, 2, 3, 2)
    rows = stacking.celled(cases, folds, ("a",), "y").collect()
    assert len(rows) == 400
    sizes = defaultdict(lambda: [0] * stacking.PARTS)
    for r in rows:
        sizes[r["repeat"], r["fold"], r["y"]][r["part"]] += 1
    assert all(max(s) - min(s) <= 1 for s in sizes.values())


def test_awkward_rows(spark):
    cases, folds = corpus(spark, 60, 1, 2, 3)
    unplaced = cases.union(spark.createDataFrame([("x", None, 1.0, 1.0, 7.0), ("lost", 1, 1.0, 1.0, 7.0)], cases.schema))
    got = stacking.stacked(unplaced, folds.union(spark.createDataFrame([("x", 0, 1)], folds.schema)), ("a", "b"), "y")
    assert got.count() == 60 and all(0 <= r["p"] <= 1 for r in got.collect())
    assert stacking.stacked(cases.limit(0), folds, ("a",), "y").count() == 0
    with pytest.raises(ValueError, match="four are needed"):
        stacking.stacked(cases.where("y = 1"), folds, ("a",), "y")
    with pytest.raises(Exception, match="missing or not finite"):
        stacking.stacked(cases.selectExpr("id", "y", "if(id = 'c3', double('nan'), a) a"), folds, ("a",), "y").collect()
    with pytest.raises(ValueError, match="calibrate"):
        stacking.stacked(cases, folds, ("a",), "y", "best")


def test_plain_heads_bear_large_means_missing_labels_and_one_class(spark):
    from veriframe.operators import learned

    rng = random.Random(8)
    rows = [(f"c{i}", int(rng.random() < 0.4), rng.gauss(0, 1)) for i in range(120)]
    rows = [(i, y, x + y) for i, y, x in rows]
    folds = spark.createDataFrame([(i, 0, k % 3) for k, (i, *_) in enumerate(rows)] + [("u", 0, 1), ("v", 1, 0), ("w", 1, 1)], "id string, repeat int, fold int")
    p = {}
    for shift in (0.0, 1e9):
        df = spark.createDataFrame([(i, y, x + shift) for i, y, x in rows] + [("u", None, 0.5 + shift), ("v", 1, shift), ("w", 0, shift)], "id string, y int, x double")
        p[shift] = {r["id"]: r["p"] for r in learned.oof_logistic(df, folds, ("x",), "y").collect()}
    for k in range(3):
        w, b = slow_head([[x] for j, (_, _, x) in enumerate(rows) if j % 3 != k], [y for j, (_, y, _) in enumerate(rows) if j % 3 != k], 1.0)
        assert all(p[0.0][i] == pytest.approx(1 / (1 + math.exp(-(w[0] * x + b))), abs=1e-8) for j, (i, _, x) in enumerate(rows) if j % 3 == k)
    assert p[1e9] == pytest.approx(p[0.0], abs=1e-5)
    assert 0 < p[0.0]["u"] < 1 and p[0.0]["v"] == 0.0 and p[0.0]["w"] == 1.0
