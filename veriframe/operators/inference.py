"""Resampling and exact tests.

Metrics of confusion counts are resampled by drawing the counts: a bootstrap of n rows is a
multinomial draw over the cells, so a draw costs the number of cells and not n. Draws are seeded by
their own number and come out the same wherever they run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import two_sided_binomial


def macro_f1_counts(tn, fp, fn, tp):
    """Of arrays of counts; a class on neither side counts 0."""
    half = lambda a, b: np.divide(2 * a, 2 * a + b, out=np.zeros(np.shape(a)), where=(2 * a + b) > 0)
    return (half(tn, fp + fn) + half(tp, fp + fn)) / 2


def draws(df_counts: Sequence[int], spark, b: int, seed: int, metric: Callable[[np.ndarray], np.ndarray], strata: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """(draw, value): metric of b resampled rows of counts. strata lists cells whose total stays as it is."""
    counts = np.array(df_counts, np.int64)
    parts = [list(range(len(counts)))] if strata is None else [list(s) for s in strata]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), len(counts)), np.int64)
            for row, i in enumerate(batch["id"].tolist()):
                rng = np.random.default_rng([seed, i])
                for cells in parts:
                    n = counts[cells].sum()
                    if n:
                        out[row, cells] = rng.multinomial(n, counts[cells] / n)
            yield pd.DataFrame({"draw": batch["id"], "value": metric(out).astype(float)})

    return spark.range(b).mapInPandas(run, "draw long, value double")


def cells(df: DataFrame, columns: Sequence[str]) -> list[int]:
    """Counts of all combinations of 0/1 columns, the first column slowest. 2^k numbers come to the driver."""
    index = sum((F.col(c).cast("int") * (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)), F.lit(0))
    found = {r["i"]: r["n"] for r in df.groupBy(index.alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(i, 0) for i in range(1 << len(columns))]


def bootstrap_macro_f1(df: DataFrame, y: str, pred: str, b: int = 10_000, seed: int = 0) -> DataFrame:
    """One row (value, lo, hi): macro-F1 and its 95 % percentile interval."""
    counts = cells(df, [y, pred])
    value = float(macro_f1_counts(*np.array(counts)[:, None].astype(float))[0])
    drawn = draws(counts, df.sparkSession, b, seed, lambda c: macro_f1_counts(*c.T.astype(float)))
    return drawn.agg(F.lit(value).alias("value"), F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"))


def paired_counts(c: np.ndarray) -> np.ndarray:
    """Difference of macro-F1, second less first, from counts of (y, a, b)."""
    k = c.T.astype(float)
    a = macro_f1_counts(k[0] + k[1], k[2] + k[3], k[4] + k[5], k[6] + k[7])
    b = macro_f1_counts(k[0] + k[2], k[1] + k[3], k[4] + k[6], k[5] + k[7])
    return b - a


def paired_bootstrap(df: DataFrame, y: str, first: str, second: str, b: int = 10_000, seed: int = 0, stratified: bool = False) -> DataFrame:
    """One row (delta, lo, hi, p): gain of the second over the first; p counts draws on the other side of
    0, 0 itself on both, and is 1 where all are 0. Stratified draws keep each class's size."""
    counts = cells(df, [y, first, second])
    delta = float(paired_counts(np.array([counts]))[0])
    drawn = draws(counts, df.sparkSession, b, seed, paired_counts, [range(4), range(4, 8)] if stratified else None)
    agg = drawn.agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.avg((F.col("value") <= 0).cast("double")).alias("down"), F.avg((F.col("value") >= 0).cast("double")).alias("up"))
    return agg.select(F.lit(delta).alias("delta"), "lo", "hi", F.least(F.lit(1.0), 2 * F.least("down", "up")).alias("p"))


def verdict(lo: float, hi: float) -> str:
    """`rejected` only below 0, `supported` only above; else `untested`."""
    return "rejected" if hi < 0 else "supported" if lo > 0 else "untested"


def mcnemar(df: DataFrame, y: str, first: str, second: str) -> DataFrame:
    """One row (b, c, p): cases that only the first, only the second has right, and the exact two-sided p."""
    ok = lambda p: F.col(p) == F.col(y)
    counts = df.agg(F.count_if(ok(first) & ~ok(second)).alias("b"), F.count_if(~ok(first) & ok(second)).alias("c"))
    return counts.select("b", "c", two_sided_binomial(F.col("b"), F.col("c")).alias("p"))


def reconstruct_confusion(spark, n: int, n_gold: int, n_pred: int, target: float) -> DataFrame:
    """One row (tn, fp, fn, tp): the first confusion with these margins whose macro-F1 is nearest the target."""
    low, high = max(0, n_gold + n_pred - n), min(n_gold, n_pred)
    tp = spark.range(low, high + 1).withColumnRenamed("id", "tp")
    all_ = tp.select("tp", (n_pred - F.col("tp")).alias("fp"), (n_gold - F.col("tp")).alias("fn"), (n - n_gold - n_pred + F.col("tp")).alias("tn"))
    from .metrics import macro_f1

    return all_.agg(F.min_by(F.struct("tn", "fp", "fn", "tp"), F.struct(F.abs(macro_f1() - target), "tp")).alias("b")).select("b.*")


def seeded_paired_bootstrap(df: DataFrame, y: str, first: Sequence[str], second: Sequence[str], b: int = 10_000, seed: int = 0) -> DataFrame:
    """One row (delta, lo, hi, p, verdict): gain of the second runs over the first, pairs by seed, mean over seeds.

    A case is a cell of its label and all its decisions, so a draw is over the cells there are: at
    most 2^(2 seeds + 1), and no more than cases. One draw resamples cases for all runs alike."""
    if len(first) != len(second) or not first:
        raise ValueError("runs must come in pairs by seed")
    columns = [y, *first, *second]
    index = sum((F.col(c).cast("int") * (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)), F.lit(0))
    found = sorted((r["i"], r["n"]) for r in df.groupBy(index.alias("i")).agg(F.count(F.lit(1)).alias("n")).collect())
    bits = np.array([[i >> (len(columns) - 1 - c) & 1 for c in range(len(columns))] for i, _ in found])
    counts = [n for _, n in found]

    def gain(c: np.ndarray) -> np.ndarray:
        w = c.astype(float)
        part = lambda col, a, p: w @ ((bits[:, 0] == a) & (bits[:, col] == p)).astype(float)
        f1 = lambda col: macro_f1_counts(part(col, 0, 0), part(col, 0, 1), part(col, 1, 0), part(col, 1, 1))
        k = len(first)
        return sum(f1(1 + k + s) - f1(1 + s) for s in range(k)) / k

    delta = float(gain(np.array([counts]))[0])
    drawn = draws(counts, df.sparkSession, b, seed, gain)
    agg = drawn.agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.avg((F.col("value") <= 0).cast("double")).alias("down"), F.avg((F.col("value") >= 0).cast("double")).alias("up"))
    said = F.when(F.col("hi") < 0, "rejected").when(F.col("lo") > 0, "supported").otherwise("untested")
    return agg.select(F.lit(delta).alias("delta"), "lo", "hi", F.least(F.lit(1.0), 2 * F.least("down", "up")).alias("p"), said.alias("verdict"))
