"""Logistic heads fitted for all folds at once.

A row stays in its partition: each pass adds up, for every fold's model, the gradient and the
curvature over the rows the model may see. What comes to the driver is (features + 1)(features + 2) numbers a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .stacking import Head, Heads, fit, moments, scored


def oof_logistic(df: DataFrame, folds: DataFrame, features: Sequence[str], y: str, c: float = 1.0, passes: int = 12) -> DataFrame:
    """(id, p): out-of-fold probability of each placed case, mean over repeats.

    Each (repeat, fold) has its own head, fitted on the repeat's other folds: features by that
    training set's mean and population deviation (1 where it is 0), classes weighted to equal
    halves, half the squared weights plus c times the weighted loss, free intercept. A training
    set of one class predicts that class, one of no rows 1/2. Cases without a label are predicted
    and teach nothing. Newton steps; twelve leave nothing to gain on scaled data."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select("id", F.col(y).cast("int").alias("y"), x.alias("x")).join(folds.select("id", "repeat", "fold"), "id")
    rows = materialise(rows.select("id", "repeat", "fold", F.lit(0).alias("part"), F.lit(0).alias("inner"), "y", "x"))
    labelled, d = rows.where("y is not null"), len(features)
    cells = moments(labelled, d)
    at = sorted((r["repeat"], r["fold"]) for r in rows.select("repeat", "fold").distinct().collect())
    heads = fit(labelled, Heads([Head(r, f, -1, None, c) for r, f in at], cells, d), passes)
    wanted = scored(rows, heads, lambda h, cell: (h.repeat, h.fold) == cell[:2], ["id"])
    p = 1 / (1 + F.exp(-F.col("z")))
    for k, h in enumerate(heads.heads):
        if not heads.free[k]:
            taught = [m.n for cell, m in cells.items() if h.learns(*cell)]
            p = F.when(F.col("head") == k, F.lit(float(sum(n[1] for n in taught) > 0) if taught else 0.5)).otherwise(p)
    return wanted.select("id", p.alias("p")).groupBy("id").agg(F.avg("p").alias("p"))


def kept_by_interval(increments: DataFrame) -> DataFrame:
    """Features (feature, lo, hi) whose gain's interval lies above 0."""
    return increments.where(F.col("lo") > 0).select("feature")
