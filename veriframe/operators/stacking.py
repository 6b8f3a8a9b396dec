"""A stack of features: logistic heads whose strength is searched inside, calibrated, all folds at once.

Every placed case lies in a cell: its repeat and fold, a calibration part and an inner part (both by rank of a
hash among the cases of its fold and label). Whatever is fitted, is fitted on a union of cells:

* a head of (repeat, fold, part, inner part, strength) on the cases outside all three, judged by ROC-AUC
  on the inner part; the best strength of (repeat, fold, part) is then fitted on both inner sides;
* the calibration of that head on the calibration part, which the head has not seen;
* a case's probability in a repeat is the mean of its fold's calibrated heads.

Heads are fitted together: a pass over the rows adds up gradients and curvatures of all heads that may see
a row, as matrix products by cell. Scalings differ by training set, so heads work on the same scaled
features and each has its own penalty instead, which has the same optimum."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .sampling import stratum_rank

#: Strengths that are searched, parts for the search and for calibration.
STRENGTHS, PARTS = (0.01, 0.1, 1.0, 10.0, 100.0), 3
#: Training sets of so many cases or more are calibrated by isotonic regression, smaller ones by a sigmoid.
ISOTONIC_FROM = 500
#: Newton steps at most, and the change of weights that ends them.
PASSES, SETTLED = 25, 1e-10
#: Log odds are counted in so many bins between -EDGE and EDGE when strengths are compared.
BINS, EDGE = 4096, 16.0
#: Distinct scores that one task pools.
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class Head:
    """Fitted on a repeat's cases outside its fold, its part and, if any, its inner part."""

    repeat: int
    fold: int
    part: int
    inner: int | None
    c: float

    def learns(self, repeat: int, fold: int, part: int, inner: int) -> bool:
        return repeat == self.repeat and fold != self.fold and part != self.part and (self.inner is None or inner != self.inner)


def celled(df: DataFrame, folds: DataFrame, features: Sequence[str], y: str, parts: int = PARTS, seed: int = 0) -> DataFrame:
    """(id, repeat, fold, part, inner, y, x) of the placed cases with a label. Parts are even among the cases of a
    fold and label, by rank of a hash."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.where(F.col(y).isNotNull()).select("id", F.col(y).cast("int").alias("y"), x.alias("x")).join(folds.select("id", "repeat", "fold"), "id")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) | F.raise_error(F.concat(F.lit("a feature is missing or not finite in "), "id")).cast("boolean"))

    placed = stratum_rank(rows, ["repeat", "fold", "y"], f"part:{seed}").withColumn("part", F.pmod(F.col("rank"), F.lit(parts)).cast("int")).drop("rank", "size")
    placed = stratum_rank(placed, ["repeat", "fold", "y", "part"], f"inner:{seed}").withColumn("inner", F.pmod(F.col("rank"), F.lit(parts)).cast("int"))
    return materialise(placed.select("id", "repeat", "fold", "part", "inner", "y", "x"))


CELL = ("repeat", "fold", "part", "inner")


@dataclass
class Moments:
    """Cases, and means and squared deviations of their features; adding two loses no digits to large means."""

    n: np.ndarray  # of each label
    mean: np.ndarray
    squares: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        a, b = self.n.sum(), other.n.sum()
        if not a or not b:
            return other if not a else self
        step = other.mean - self.mean
        return Moments(self.n + other.n, self.mean + step * b / (a + b), self.squares + other.squares + step**2 * a * b / (a + b))

    @property
    def deviation(self) -> np.ndarray:
        """Population deviations, 1 where a feature is constant."""
        found = np.sqrt(self.squares / max(1, self.n.sum()))
        return np.where(found > 1e-12 * np.maximum(1, np.abs(self.mean)), found, 1.0)


def moments(rows: DataFrame, d: int) -> dict[tuple, Moments]:
    """By cell; cells are few (repeats, folds and parts), so they come to the driver."""
    at = lambda i: F.get("x", F.lit(i))
    found = rows.groupBy(*CELL, "y").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(at(i)) for i in range(d)]).alias("mean"), F.array(*[F.var_pop(at(i)) for i in range(d)]).alias("var")).collect()
    out: dict[tuple, Moments] = {}
    for r in sorted(found, key=lambda r: [r[c] for c in (*CELL, "y")]):
        own = Moments(np.array([r["n"] * (r["y"] == 0), r["n"] * (r["y"] == 1)], float), np.array(r["mean"]), np.array(r["var"]) * r["n"])
        key = tuple(r[c] for c in CELL)
        out[key] = out[key] + own if key in out else own
    return out


class Heads:
    """Heads with their training sets' class weights and penalties, and weights on features scaled by all rows."""

    def __init__(self, heads: Sequence[Head], cells: dict[tuple, Moments], d: int):
        self.heads, self.cells, self.d = list(heads), cells, d
        nothing = Moments(np.zeros(2), np.zeros(d), np.zeros(d))
        every = sum(cells.values(), nothing)
        self.mean, self.std = every.mean, every.deviation
        self.beta, self.weights, self.ridge = np.zeros((len(self.heads), d + 1)), np.ones((len(self.heads), 2)), np.zeros((len(self.heads), d + 1))
        self.free = np.ones(len(self.heads), bool)
        sets: dict[tuple, Moments] = {}
        for i, h in enumerate(self.heads):
            key = (h.repeat, h.fold, h.part, h.inner)
            if key not in sets:
                sets[key] = sum((m for cell, m in cells.items() if h.learns(*cell)), nothing)
            m = sets[key]
            if (m.n == 0).any():  # one class: that class, whatever the features
                self.free[i] = False
                self.beta[i, -1] = EDGE * float(np.sign(m.n[1] - m.n[0]))
                continue
            self.weights[i] = m.n.sum() / (2 * m.n) * h.c
            self.ridge[i, :-1] = (m.deviation / self.std) ** 2
        self.learners = {cell: np.array([i for i, h in enumerate(self.heads) if self.free[i] and h.learns(*cell)], int) for cell in cells}

    def scaled(self, x: pd.Series) -> np.ndarray:
        z = (np.stack(x.to_numpy()) - self.mean) / self.std
        return np.hstack([z, np.ones((len(z), 1))])


def by_cell(b: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray]]:
    for cell, at in b.groupby(list(CELL), sort=False).indices.items():
        yield tuple(int(c) for c in cell), at


def fit(rows: DataFrame, heads: Heads, passes: int = PASSES) -> Heads:
    """Newton's steps for all heads; each pass brings (d + 1)(d + 2) sums a head to the driver."""
    d1 = heads.d + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(heads.heads), d1 * (d1 + 1)))
        for b in batches:
            for cell, at in by_cell(b):
                use = heads.learners[cell]
                if not len(use):
                    continue
                z, y = heads.scaled(b["x"].iloc[at]), b["y"].to_numpy()[at][:, None]
                p = 1 / (1 + np.exp(-np.clip(z @ heads.beta[use].T, -35, 35)))
                w = np.where(y == 1, heads.weights[use, 1], heads.weights[use, 0])
                squares = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
                total[use, :d1] += (z.T @ (w * (p - y))).T
                total[use, d1:] += (squares.T @ (w * p * (1 - p))).T
        some = np.nonzero(total.any(axis=1))[0]
        yield pd.DataFrame({"head": some, "v": list(total[some])})

    for _ in range(passes if heads.free.any() else 0):
        added = rows.select(*CELL, "y", "x").mapInPandas(sums, "head int, v array<double>").select("head", F.posexplode("v").alias("i", "v")).groupBy("head", "i").agg(F.sum("v").alias("v"))
        total = np.zeros((len(heads.heads), d1 * (d1 + 1)))
        for r in added.collect():
            total[r["head"], r["i"]] = r["v"]
        most = 0.0
        for i in np.nonzero(heads.free)[0]:
            ridge = np.diag(heads.ridge[i])
            step = np.linalg.solve(total[i, d1:].reshape(d1, d1) + ridge + 1e-12 * np.eye(d1), total[i, :d1] + ridge @ heads.beta[i])
            heads.beta[i] -= step
            most = max(most, float(np.abs(step).max()))
        if most < SETTLED:
            break
    return heads


def search(rows: DataFrame, cells: dict[tuple, Moments], d: int, strengths: Sequence[float], parts: int) -> dict[tuple, float]:
    """The strength of each (repeat, fold, part) whose heads have the best mean ROC-AUC over inner parts, of equals
    the first. The area is of log odds counted in BINS, those of one bin as ties; inner parts with
    one class, or that no head could learn for, don't count."""
    at = sorted({c[:2] for c in cells})
    heads = fit(rows, Heads([Head(r, f, p, i, c) for (r, f), p, i, c in product(at, range(parts), range(parts), strengths)], cells, d))
    judges = {cell: np.array([k for k, h in enumerate(heads.heads) if h.repeat == cell[0] and h.fold != cell[1] and h.part != cell[2] and h.inner == cell[3]], int) for cell in cells}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, place in by_cell(b):
                use = judges[cell]
                if not len(use):
                    continue
                z = heads.scaled(b["x"].iloc[place]) @ heads.beta[use].T
                bins = np.clip((z + EDGE) * (BINS / (2 * EDGE)), 0, BINS - 1).astype(np.int64)
                codes, n = np.unique((use[None, :] * BINS + bins) * 2 + b["y"].to_numpy()[place][:, None], return_counts=True)
                yield pd.DataFrame({"head": codes // (2 * BINS), "bin": codes // 2 % BINS, "pos": n * (codes % 2), "neg": n * (1 - codes % 2)})

    bins = rows.select(*CELL, "y", "x").mapInPandas(counted, "head int, bin int, pos long, neg long").groupBy("head", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy("head").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    areas = bins.withColumn("lower", lower).groupBy("head").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)).alias("wins"))
    found: dict[tuple, list[float]] = {}
    for r in areas.collect():
        h = heads.heads[r["head"]]
        if r["pos"] and r["neg"] and heads.free[r["head"]]:
            found.setdefault((h.repeat, h.fold, h.part, h.c), []).append(r["wins"] / (r["pos"] * r["neg"]))
    mean = lambda key: np.mean(sorted(found.get(key, [0.5])))
    return {(r, f, p): max(strengths, key=lambda c: (mean((r, f, p, c)), -strengths.index(c))) for (r, f), p in product(at, range(parts))}


def scored(rows: DataFrame, heads: Heads, uses: Callable[[Head, tuple], bool], keep: Sequence[str]) -> DataFrame:
    """(keep, head, z): log odds of each row by every head that uses(head, cell) names."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keep}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named: dict[tuple, np.ndarray] = {}
        for b in batches:
            for cell, at in by_cell(b):
                if cell not in named:
                    named[cell] = np.array([k for k, h in enumerate(heads.heads) if uses(h, cell)], int)
                use = named[cell]
                if len(use):
                    z = heads.scaled(b["x"].iloc[at]) @ heads.beta[use].T
                    yield pd.DataFrame({**{c: np.repeat(b[c].to_numpy()[at], len(use)) for c in keep}, "head": np.tile(use, len(at)), "z": z.ravel()})

    given = rows.select(*dict.fromkeys([*CELL, "x", *keep]))
    return given.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", head int, z double")


def sigmoids(counts: DataFrame, passes: int = 60) -> dict[int, tuple[float, float]]:
    """{head: (a, b)} of 1 / (1 + exp(-(a z + b))), Platt's: least log loss against (positives + 1) / (positives
    + 2) and 1 / (negatives + 2). counts is (head, z, n, pos); each pass brings five sums a head to the driver."""
    whole = {r["head"]: r for r in counts.groupBy("head").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum(F.col("z") * F.col("n")).alias("s")).collect()}
    spread = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(h, float(r["s"] / r["n"])) for h, r in whole.items()], "head int, m double")), "head") if whole else None
    deviation = {r["head"]: max(1e-12, float(np.sqrt(r["q"]))) for r in spread.groupBy("head").agg((F.sum(F.col("n") * (F.col("z") - F.col("m")) ** 2) / F.sum("n")).alias("q")).collect()} if whole else {}
    now = {h: np.array([0.0, np.log((r["pos"] + 1.0) / (r["n"] - r["pos"] + 1.0))]) for h, r in whole.items()}
    scale = {h: (float(r["s"] / r["n"]), deviation[h]) for h, r in whole.items()}
    high = {h: (r["pos"] + 1.0) / (r["pos"] + 2.0) for h, r in whole.items()}
    low = {h: 1.0 / (r["n"] - r["pos"] + 2.0) for h, r in whole.items()}
    for _ in range(passes if now else 0):

        def sums(batches: Iterator[pd.DataFrame], now=dict(now)) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for h, b in batch.groupby("head"):
                    x = (b["z"].to_numpy() - scale[h][0]) / scale[h][1]
                    n, pos = b["n"].to_numpy(float), b["pos"].to_numpy(float)
                    p = 1 / (1 + np.exp(-np.clip(now[h][0] * x + now[h][1], -35, 35)))
                    off, w = n * p - pos * high[h] - (n - pos) * low[h], n * p * (1 - p)
                    yield pd.DataFrame({"head": [h], "g0": [(off * x).sum()], "g1": [off.sum()], "h00": [(w * x * x).sum()], "h01": [(w * x).sum()], "h11": [w.sum()]})

        parts = counts.mapInPandas(sums, "head int, g0 double, g1 double, h00 double, h01 double, h11 double").groupBy("head").agg(*[F.sum(c).alias(c) for c in ("g0", "g1", "h00", "h01", "h11")])
        most = 0.0
        for r in parts.collect():
            step = np.linalg.solve(np.array([[r["h00"], r["h01"]], [r["h01"], r["h11"]]]) + 1e-10 * np.eye(2), np.array([r["g0"], r["g1"]]))
            step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
            now[r["head"]] = now[r["head"]] - step
            most = max(most, float(np.abs(step).max()))
        if most < SETTLED:
            break
    return {h: (float(a / scale[h][1]), float(b - a * scale[h][0] / scale[h][1])) for h, (a, b) in now.items()}


def pooled(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, x0, x1, n, pos): blocks of scores (by, x0, x1, n, pos), in the order of x0, with adjacent violators pooled: means
    rise strictly. Any order of pooling gives the same blocks, so ranges can be pooled first, and what is
    left of them together. A task holds the blocks of one key, whose means differ, and not its scores."""
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        out = lambda: pd.DataFrame([(*key, *x) for x in held], columns=[*by, "x0", "x1", "n", "pos"])
        for b in batches:
            keys = zip(*[b[c].tolist() for c in by], strict=True)
            for k, x0, x1, n, pos in zip(keys, b["x0"].tolist(), b["x1"].tolist(), b["n"].tolist(), b["pos"].tolist(), strict=True):
                if k != key:
                    if held:
                        yield out()
                    key, held = k, []
                while held and held[-1][3] * n >= pos * held[-1][2]:  # whole numbers: exact
                    x0, _, m, q = held.pop()
                    n, pos = n + m, pos + q
                held.append((x0, x1, n, pos))
        if held:
            yield out()

    return blocks.repartition(*by).sortWithinPartitions(*by, "x0").select(*by, "x0", "x1", "n", "pos").mapInPandas(run, f"{kinds}, x0 double, x1 double, n long, pos long")


def range_of(z: Column, head: Column, cuts: dict[int, list[float]]) -> Column:
    """How many of its head's cuts lie below z."""
    if not any(cuts.values()):
        return F.lit(0)
    every = F.create_map(*[x for h, cs in sorted(cuts.items()) for x in (F.lit(h), F.array(*map(F.lit, cs)).cast("array<double>"))])
    return F.coalesce(F.size(F.filter(F.try_element_at(every, head), lambda c: c < z)), F.lit(0))


def isotonic(counts: DataFrame) -> tuple[DataFrame, dict[int, list[float]]]:
    """Blocks (head, x0, x1, n, pos) of isotonic regression on counts (head, z, n, pos), distinct in head and z, and
    the cuts into ranges: each of about RANGE_ROWS scores is pooled by itself, then their blocks."""
    sizes = {r["head"]: r["n"] for r in counts.groupBy("head").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max([1, *[-(-n // RANGE_ROWS) for n in sizes.values()]])
    cuts: dict[int, list[float]] = {h: [] for h in sizes}
    if most > 1:
        wanted = F.array(*[F.lit(i / most) for i in range(1, most)])
        cuts = {r["head"]: sorted(set(r["q"])) for r in counts.groupBy("head").agg(F.percentile_approx("z", wanted, F.lit(20 * most)).alias("q")).collect()}
    placed = counts.select("head", range_of(F.col("z"), F.col("head"), cuts).alias("range"), F.col("z").alias("x0"), F.col("z").alias("x1"), "n", "pos")
    first = pooled(placed, ["head", "range"])
    return pooled(first.drop("range"), ["head"]), cuts


def interpolated(scores: DataFrame, blocks: DataFrame, cuts: dict[int, list[float]]) -> DataFrame:
    """scores (head, z, ...) with p: the value of the block that z lies in, between two blocks on the line that joins them,
    outside all the nearest one's. Each block goes to the ranges from its begin to the next one's, so a range's
    scores meet the blocks they need and no others."""
    w = Window.partitionBy("head").orderBy("x0")
    value = F.col("pos") / F.col("n")
    lines = blocks.select("head", "x0", "x1", value.alias("v"), F.lead("x0").over(w).alias("next"), F.lead(value).over(w).alias("next_v"), (F.row_number().over(w) == 1).alias("first"))
    last = F.size(F.try_element_at(F.create_map(*[x for h, cs in sorted(cuts.items()) for x in (F.lit(h), F.array(*map(F.lit, cs)).cast("array<double>"))]), F.col("head"))) if cuts else F.lit(0)
    begin = F.when(F.col("first"), F.lit(0)).otherwise(range_of(F.col("x0"), F.col("head"), cuts))
    end = F.when(F.col("next").isNull(), last).otherwise(range_of(F.col("next"), F.col("head"), cuts))
    spread = lines.select("head", F.explode(F.sequence(begin, end)).alias("range"), F.when(F.col("first"), F.lit(float("-inf"))).otherwise(F.col("x0")).alias("z"), F.struct("x0", "x1", "v", "next", "next_v").alias("line"))
    others = [c for c in scores.columns if c not in ("head", "z")]
    rows = scores.select("head", range_of(F.col("z"), F.col("head"), cuts).alias("range"), "z", F.struct(*others).alias("row"))
    both = spread.select("*", F.lit(None).cast(rows.schema["row"].dataType).alias("row")).unionByName(rows.select("*", F.lit(None).cast(spread.schema["line"].dataType).alias("line")))
    order = Window.partitionBy("head", "range").orderBy("z", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("line", F.last("line", ignorenulls=True).over(order)).where(F.col("row").isNotNull())
    line, z = F.col("line"), F.col("z")
    sloped = line["v"] + (line["next_v"] - line["v"]) * (z - line["x1"]) / F.nullif(line["next"] - line["x1"], F.lit(0.0))
    p = F.when((z <= line["x1"]) | line["next"].isNull(), line["v"]).otherwise(sloped)
    return at.select("head", "z", "row.*", p.alias("p"))


def stacked(
    df: DataFrame, folds: DataFrame, features: Sequence[str], y: str, calibrate: str = "auto", strengths: Sequence[float] = STRENGTHS, parts: int = PARTS, seed: int = 0,
) -> DataFrame:
    """(id, p): calibrated out-of-fold probability of each placed case with a label, mean over repeats and parts.

    calibrate is isotonic, sigmoid (or platt), or auto: isotonic for training sets of ISOTONIC_FROM cases and
    sigmoid below. A feature that is null or not finite is an error, and so is a training set with fewer than
    four cases of a class. Cases of repeated ids count each; no cases give no rows."""
    if calibrate not in ("auto", "isotonic", "sigmoid", "platt"):
        raise ValueError(f"calibrate must be auto, isotonic, sigmoid or platt, not {calibrate}")
    if not features or len(set(features)) != len(features):
        raise ValueError("features must be named, each once")
    rows, d = celled(df, folds, features, y, parts, seed), len(features)
    cells = moments(rows, d)
    train: dict[tuple, np.ndarray] = {}
    for r, f in {c[:2] for c in cells}:
        train[r, f] = sum((m.n for c, m in cells.items() if c[0] == r and c[1] != f), np.zeros(2))
        if train[r, f].min() < 4:
            raise ValueError(f"repeat {r} has {train[r, f].astype(int).tolist()} training cases of each class outside fold {f}; four are needed")
    best = search(rows, cells, d, strengths, parts)
    heads = fit(rows, Heads([Head(r, f, p, None, c) for (r, f, p), c in sorted(best.items())], cells, d))
    iso = [k for k, h in enumerate(heads.heads) if calibrate == "isotonic" or calibrate == "auto" and train[h.repeat, h.fold].sum() >= ISOTONIC_FROM]
    seen = scored(rows, heads, lambda h, cell: h.repeat == cell[0] and h.fold != cell[1] and h.part == cell[2], ["y"])
    counts = materialise(seen.groupBy("head", "z").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos")))
    wanted = scored(rows, heads, lambda h, cell: h.repeat == cell[0] and h.fold == cell[1], ["id"])
    by_isotonic = F.col("head").isin(iso) if iso else F.lit(False)
    curves = sigmoids(counts.where(~by_isotonic)) if len(iso) < len(heads.heads) else {}
    p = F.lit(None).cast("double")
    if curves:
        ab = F.try_element_at(F.create_map(*[x for h, (a, b) in sorted(curves.items()) for x in (F.lit(h), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))]), F.col("head"))
        p = 1 / (1 + F.exp(-(ab["a"] * F.col("z") + ab["b"])))
    out = wanted.where(~by_isotonic).select("id", p.alias("p"))
    if iso:
        blocks, cuts = isotonic(counts.where(by_isotonic))
        out = out.unionByName(interpolated(wanted.where(by_isotonic), materialise(blocks), cuts).select("id", "p"))
    return out.groupBy("id").agg(F.avg("p").alias("p"))
