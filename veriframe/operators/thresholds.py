"""Threshold searches on histograms and cross-validation with thresholds fitted inside.

Rows are counted by grid bin once; a sum from the top gives the confusion at every grid point, and
a fold's training counts are all counts less the fold's own, so no row is read again for a fold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import metrics
from .inference import macro_f1_counts

STEPS = 100


def grid_bin(score: Column, steps: int = STEPS) -> Column:
    """The largest i of 0..steps with grid point i at or below the score; grid points are i * (1/steps), the last 1."""
    point = lambda i: F.when(i >= steps, F.lit(1.0)).otherwise(i * F.lit(1.0 / steps))
    near = F.floor(score * steps).cast("int")
    up = F.when((near + 1 <= steps) & (score >= point(near + 1)), near + 1).otherwise(near)
    return F.when(score < point(up), up - 1).otherwise(up)


def threshold_of(bin_: Column, steps: int = STEPS) -> Column:
    return F.when(bin_ >= steps, F.lit(1.0)).otherwise(bin_ * F.lit(1.0 / steps))


def histogram(df: DataFrame, y: str, score: str, by: Sequence[str] = (), steps: int = STEPS) -> DataFrame:
    """(by, bin, n0, n1)."""
    return df.groupBy(*by, grid_bin(F.col(score), steps).alias("bin")).agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"))


def sweep(counts: DataFrame, by: Sequence[str] = (), steps: int = STEPS) -> DataFrame:
    """(by, bin, threshold, tn, fp, fn, tp, macro_f1) at each grid point; a score at or above the point is positive."""
    spine = counts.select(*by).distinct() if by else counts.groupBy().agg(F.count(F.lit(1)).alias("_")).drop("_")
    spine = spine.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    filled = spine.join(counts, [*by, "bin"], "left").select(*by, "bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n0", "n1")])
    down = Window.partitionBy(*by).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    at = filled.select(
        *by, "bin", threshold_of(F.col("bin"), steps).alias("threshold"), F.sum("n0").over(down).alias("fp"), F.sum("n1").over(down).alias("tp"),
        F.sum("n0").over(every).alias("all0"), F.sum("n1").over(every).alias("all1"),
    ).withColumn("tn", F.col("all0") - F.col("fp")).withColumn("fn", F.col("all1") - F.col("tp"))
    return at.select(*by, "bin", "threshold", "tn", "fp", "fn", "tp", metrics.macro_f1().alias("macro_f1"))


def best(swept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, macro_f1): the lowest of the best thresholds."""
    top = F.max_by(F.struct("threshold", "macro_f1"), F.struct("macro_f1", -F.col("bin"))).alias("b")
    return swept.groupBy(*by).agg(top).select(*by, "b.threshold", "b.macro_f1")


def fit(df: DataFrame, y: str, score: str, by: Sequence[str] = (), steps: int = STEPS) -> DataFrame:
    return best(sweep(histogram(df, y, score, by, steps), by, steps), by)


def fit_pair(df: DataFrame, y: str, first: str, second: str, steps: int = STEPS) -> DataFrame:
    """One row (t_first, t_second, macro_f1): both scores must reach their thresholds; ties go to the
    lower first, then second threshold. Counts by pairs of bins are summed from the top both ways."""
    cells = df.groupBy(grid_bin(F.col(first), steps).alias("i"), grid_bin(F.col(second), steps).alias("j")).agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"))
    axis = df.sparkSession.range(steps + 1)
    spine = axis.select(F.col("id").cast("int").alias("i")).crossJoin(axis.select(F.col("id").cast("int").alias("j")))  # the grid, not rows
    full = spine.join(cells, ["i", "j"], "left").select("i", "j", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n0", "n1")])
    along = Window.partitionBy("i").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("j").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = full.select("i", "j", F.sum("n0").over(along).alias("a0"), F.sum("n1").over(along).alias("a1")).select("i", "j", F.sum("a0").over(up).alias("fp"), F.sum("a1").over(up).alias("tp"))
    totals = F.broadcast(cells.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("all0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("all1")))
    at = rows.crossJoin(totals).withColumn("tn", F.col("all0") - F.col("fp")).withColumn("fn", F.col("all1") - F.col("tp")).withColumn("macro_f1", metrics.macro_f1())
    top = at.agg(F.max_by(F.struct("i", "j", "macro_f1"), F.struct("macro_f1", -F.col("i"), -F.col("j"))).alias("b"))
    return top.select(threshold_of(F.col("b.i"), steps).alias("t_first"), threshold_of(F.col("b.j"), steps).alias("t_second"), "b.macro_f1")


def fold_thresholds(df: DataFrame, folds: DataFrame, y: str, score: str, by: Sequence[str] = (), steps: int = STEPS) -> DataFrame:
    """(by, repeat, fold, threshold, macro_f1): fitted for each fold on the other folds of its repeat."""
    own = histogram(df.join(folds, "id"), y, score, [*by, "repeat", "fold"], steps)
    return thresholds_of_counts(own, by, steps)


def train_counts(own: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, repeat, fold, bin, n0, n1) of each fold's training rows, from the counts of its own rows."""
    whole = own.groupBy(*by, "repeat", "bin").agg(F.sum("n0").alias("w0"), F.sum("n1").alias("w1"))
    folds_of = own.select(*by, "repeat", "fold").distinct()
    train = folds_of.join(whole, [*by, "repeat"]).join(own, [*by, "repeat", "fold", "bin"], "left")
    return train.select(*by, "repeat", "fold", "bin", (F.col("w0") - F.coalesce("n0", F.lit(0))).alias("n0"), (F.col("w1") - F.coalesce("n1", F.lit(0))).alias("n1"))


def thresholds_of_counts(own: DataFrame, by: Sequence[str] = (), steps: int = STEPS) -> DataFrame:
    """fold_thresholds from the counts by bin of each fold's own rows."""
    keys = [*by, "repeat", "fold"]
    return best(sweep(train_counts(own, by), keys, steps), keys)


def cross_validate(df: DataFrame, folds: DataFrame, y: str, score: str, by: Sequence[str] = (), steps: int = STEPS) -> DataFrame:
    """(by, id, y, oof_score, vote, pred): each case is judged in each repeat by the threshold of its
    fold's training rows; the decision is 1 where half of the repeats or more say so."""
    t = fold_thresholds(df, folds, y, score, by, steps).select(*by, "repeat", "fold", "threshold")
    judged = df.join(folds, "id").join(t, [*by, "repeat", "fold"])
    votes = judged.groupBy(*by, "id", F.col(y).alias("y")).agg(F.avg(score).alias("oof_score"), F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("vote"))
    return votes.withColumn("pred", (F.col("vote") >= 0.5).cast("int"))


def cross_validated_report(df: DataFrame, folds: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, n_excluded, tn, fp, fn, tp, macro_f1)."""
    votes = cross_validate(df, folds, y, score, by)
    counts = votes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *metrics.confusion("y", "pred"))
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total")) if by else df.agg(F.count(F.lit(1)).alias("total"))
    both = counts.join(total, list(by)) if by else counts.crossJoin(total)
    return both.select(*by, "n", (F.col("total") - F.col("n")).alias("n_excluded"), "tn", "fp", "fn", "tp", metrics.macro_f1().alias("macro_f1"))


#: Combinations of folds and label that drawn noise is drawn for, and counts by entropy and bins in a range of entropies.
MOST_CELLS, RANGE_CELLS = 200_000, 100_000
#: Trials that one task works on together, and parts that cases are dealt over for each such block.
BLOCK, PARTS = 50, 8


def null_distribution(df: DataFrame, folds: DataFrame, y: str, trials: int, steps: int = STEPS) -> DataFrame:
    """(trial, macro_f1): the same fold procedure on scores that are hashes of trial and id, mean of the
    repeats' F1. Trials are a key, so all run in the same few stages.

    Cases are dealt by block of trials before trials are unfolded, so noise is never shuffled and a task
    counts few keys. Thresholds are grid points, so held-out decisions are read from the same counts."""
    from ..functions.numeric import hash_unit

    placed = df.select("id", y).join(folds.groupBy("id").agg(F.collect_list(F.struct("repeat", "fold")).alias("at")), "id")
    blocks = F.sequence(F.lit(0), F.lit((trials - 1) // BLOCK))
    dealt = placed.select("*", F.explode(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part"))
    dealt = dealt.repartition(PARTS * ((trials - 1) // BLOCK + 1), "block", "part")
    each = F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.lit(trials)) - 1)
    noisy = dealt.select("id", y, "at", F.explode(each).alias("trial"))
    noisy = noisy.select(y, "at", "trial", hash_unit(F.concat(F.col("trial").cast("string"), F.lit(":"), F.col("id"))).alias("noise"))
    noisy = noisy.select(y, "trial", "at", grid_bin(F.col("noise"), steps).alias("bin"))
    rows = noisy.select(y, "trial", "bin", F.explode("at").alias("in")).select(y, "trial", "bin", "in.repeat", "in.fold")
    own = rows.groupBy("trial", "repeat", "fold", "bin").agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"))
    own = materialise(own)
    t = thresholds_of_counts(own, ["trial"], steps).select("trial", "repeat", "fold", "threshold")
    said = own.join(t, ["trial", "repeat", "fold"]).withColumn("yes", threshold_of(F.col("bin"), steps) >= F.col("threshold"))
    total = lambda n, yes: F.sum(F.when(F.col("yes") == yes, F.col(n)).otherwise(0))
    each_repeat = said.groupBy("trial", "repeat").agg(total("n0", False).alias("tn"), total("n0", True).alias("fp"), total("n1", False).alias("fn"), total("n1", True).alias("tp"))
    return each_repeat.withColumn("f1", metrics.macro_f1()).groupBy("trial").agg(F.avg("f1").alias("macro_f1"))


def null_distribution_drawn(df: DataFrame, folds: DataFrame, y: str, trials: int, steps: int = STEPS, seed: int = 0) -> DataFrame:
    """(trial, macro_f1): as null_distribution, for noise that is drawn by counts: the cases of equal label and equal
    folds in all repeats are a cell, and a trial draws how many of each cell fall into each grid bin.

    So a trial costs cells times bins, whatever the number of cases; the distribution is the same as for noise
    drawn case by case. Cells, at most labels times folds to the power of repeats, go to all tasks; over
    MOST_CELLS are an error. Cases without a label or a fold don't count; no cases give no rows."""
    placed = df.where(F.col(y).isNotNull()).select("id", F.col(y).cast("int").alias("y")).join(folds.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("repeat", "fold"))).alias("at")), "id")
    found = placed.groupBy("y", "at").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"over {MOST_CELLS} combinations of folds; null_distribution has no such bound")
    found = sorted(found, key=lambda r: (r["y"], [tuple(x) for x in r["at"]]))
    repeats, n_folds = sorted({x["repeat"] for r in found for x in r["at"]}), max([0, *[x["fold"] + 1 for r in found for x in r["at"]]])
    size, label = np.array([r["n"] for r in found], np.int64), np.array([r["y"] for r in found], int)
    fold_of = [np.array([next((x["fold"] for x in r["at"] if x["repeat"] == k), -1) for r in found], int) for k in repeats]

    def one(trial: int) -> float:
        bins = np.random.default_rng([seed, trial]).multinomial(size, np.full(steps, 1 / steps))  # none reaches the last grid point
        f1s = []
        for own in fold_of:
            counts = np.zeros((n_folds, 2, steps + 1), np.int64)
            use = own >= 0
            np.add.at(counts[:, :, :steps], (own[use], label[use]), bins[use])
            train = counts.sum(axis=0)[None] - counts
            best = macro_f1_at(train).argmax(axis=1)  # the lowest of the best
            mine = counts[counts.sum(axis=(1, 2)) > 0], best[counts.sum(axis=(1, 2)) > 0]
            upper = np.arange(steps + 1)[None, None, :] >= mine[1][:, None, None]
            yes, whole = (mine[0] * upper).sum(axis=(0, 2)), mine[0].sum(axis=(0, 2))
            f1s.append(float(macro_f1_counts(*(np.array([x], float) for x in (whole[0] - yes[0], yes[0], whole[1] - yes[1], yes[1])))[0]))
        return float(np.mean(f1s))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"trial": b["id"], "macro_f1": [one(t) for t in b["id"].tolist()]})

    return df.sparkSession.range(trials if found else 0).mapInPandas(run, "trial long, macro_f1 double")


def macro_f1_at(counts: np.ndarray) -> np.ndarray:
    """Of counts (..., label, bin): macro-F1 at each grid point, its bin and those above being positive."""
    up = np.flip(np.flip(counts, -1).cumsum(axis=-1), -1)
    fp, tp = up[..., 0, :].astype(float), up[..., 1, :].astype(float)
    tn, fn = counts[..., 0, :].sum(axis=-1, keepdims=True) - fp, counts[..., 1, :].sum(axis=-1, keepdims=True) - tp
    return macro_f1_counts(tn, fp, fn, tp)


def fit_with_entropy(df: DataFrame, y: str, contra: str, relevance: str, entropy: str | None = None, steps: int = STEPS) -> DataFrame:
    """One row (t_contra, t_entropy, t_rel, macro_f1): contradiction and entropy at most, relevance at least.

    Entropy thresholds are the observed values and infinity; without entropy, t_entropy is null. Of equal
    results the lowest contradiction, then entropy, then relevance threshold wins. A row whose entropy is
    null or no number is never positive.

    Rows are counted by entropy and bins first. Entropies are cut into ranges of about RANGE_CELLS such counts; a
    task sweeps one range upwards from the table of the grid that the ranges below add up to, updating the
    part of the grid that an entropy's counts change and looking for a better point there only. So it
    holds one range's counts and the grid, however many entropies there are."""
    up = lambda x: F.ceil(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * steps).cast("int")
    at_most = F.when((up(F.col(contra)) > 0) & (F.col(contra) <= threshold_of(up(F.col(contra)) - 1, steps)), up(F.col(contra)) - 1).when(F.col(contra) > threshold_of(up(F.col(contra)), steps), up(F.col(contra)) + 1).otherwise(up(F.col(contra)))
    e = F.col(entropy).cast("double") if entropy else F.lit(float("inf"))
    cells = df.groupBy(at_most.alias("i"), e.alias("e"), F.least(grid_bin(F.col(relevance), steps), F.lit(steps)).alias("k")).agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"))
    cells = materialise(cells)
    total, n_cells = cells.agg(F.array(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))), F.count(F.lit(1))).first()
    usable = cells.where(F.col("i").between(0, steps) & F.col("k").between(0, steps) & F.col("e").isNotNull() & ~F.isnan("e"))
    n_ranges = -(-n_cells // RANGE_CELLS)
    cuts = sorted(set(usable.where(F.abs("e") < float("inf")).approxQuantile("e", [i / n_ranges for i in range(1, n_ranges)], 1 / (4 * n_ranges)))) if n_ranges > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("e"))) if cuts else F.lit(0)
    ranged = usable.withColumn("range", place)
    sums = ranged.groupBy("range", "i", "k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # where a range adds to a cell, the cell counts in all ranges above: steps of ranges, ended by the next
    reach = Window.partitionBy("i", "k").orderBy("range")
    held = sums.select("i", "k", (F.col("range") + 1).alias("from"), F.lead("range", 1, len(cuts)).over(reach).alias("to"), *[F.sum(c).over(reach.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("n0", "n1")])
    starts = held.where("from <= to").select(F.explode(F.sequence("from", "to")).alias("range"), "i", "k", "n0", "n1")

    def sweep_range(below: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((2, steps + 1, steps + 1), np.int64)
        for part, n in enumerate(("n0", "n1")):
            np.add.at(table[part], (below["i"].to_numpy(int), below["k"].to_numpy(int)), below[n].to_numpy(np.int64))
        table = np.flip(np.flip(table.cumsum(axis=1), 2).cumsum(axis=2), 2)
        own = own.sort_values("e", kind="stable")
        es, i, k = own["e"].to_numpy(float), own["i"].to_numpy(int), own["k"].to_numpy(int)
        n = np.stack([own["n0"].to_numpy(np.int64), own["n1"].to_numpy(np.int64)])
        ends = np.flatnonzero(np.append(es[1:] != es[:-1], True)) + 1 if len(es) else []
        best, at = (-1.0, 0, 0.0, 0), 0
        for end in ends:
            low, high = i[at:end].min(), k[at:end].max() + 1
            if end - at > 8:  # many cells of one entropy: added up as a table
                fresh = np.zeros_like(table)
                for part in (0, 1):
                    np.add.at(fresh[part], (i[at:end], k[at:end]), n[part, at:end])
                table += np.flip(np.flip(fresh.cumsum(axis=1), 2).cumsum(axis=2), 2)
            else:
                for c in range(at, end):
                    table[:, i[c] :, : k[c] + 1] += n[:, c, None, None]
            if best[0] < 0:
                low, high = 0, steps + 1
            part = table[:, low:, :high].astype(float)
            f1 = macro_f1_counts(total[0] - part[0], part[0], total[1] - part[1], part[1])
            spot = int(f1.argmax())  # the lowest contradiction, then relevance
            found = (float(f1.flat[spot]), low + spot // f1.shape[1], float(es[at]), spot % f1.shape[1])
            if (found[0], -found[1], -found[2], -found[3]) > (best[0], -best[1], -best[2], -best[3]):
                best = found
            at = end
        return pd.DataFrame([(best[1], best[2], best[3], best[0])] if len(es) else [], columns=["i", "e", "k", "macro_f1"])

    swept = starts.groupBy("range").cogroup(ranged.groupBy("range")).applyInPandas(sweep_range, "i int, e double, k int, macro_f1 double")
    nothing = df.sparkSession.createDataFrame([(0, float("inf"), 0, float(macro_f1_counts(*np.array([[total[0]], [0], [total[1]], [0]], float))[0]))], swept.schema)  # infinity, where no row can be positive
    top = swept.unionByName(nothing).agg(F.max_by(F.struct("i", "e", "k", "macro_f1"), F.struct("macro_f1", -F.col("i"), -F.col("e"), -F.col("k"))).alias("b"))
    t_entropy = F.col("b.e") if entropy else F.lit(None).cast("double")
    return top.select(threshold_of(F.col("b.i"), steps).alias("t_contra"), t_entropy.alias("t_entropy"), threshold_of(F.col("b.k"), steps).alias("t_rel"), "b.macro_f1")
