"""The report of a run: every number with its interval and its place in the noise, axes, operation, spread, comparisons.

A report is a long table (section, name, value) of a few dozen rows; writers.report_json makes one value of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import inference, metrics, protocol, thresholds

#: A metric is above noise where more than this share of noise, in percent, does not beat it.
ABOVE_NOISE = 95.0


def rows(df: DataFrame, section: str, **values: str | Column) -> DataFrame:
    """One row of df as (section, name, value) rows."""
    each = [F.struct(F.lit(name).alias("name"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value")) for name, c in values.items()]
    return df.select(F.lit(section).alias("section"), F.explode(F.array(*each)).alias("x")).select("section", "x.*")


def metric(votes: DataFrame, null: DataFrame, section: str, b: int, seed: int) -> DataFrame:
    """value of the voted decisions, ci_lo, ci_hi, null_percentile and above_noise; null is (trial, macro_f1)."""
    found = inference.bootstrap_macro_f1(votes, "y", "pred", b, seed)
    place = null.crossJoin(F.broadcast(found.select("value"))).agg((100.0 * F.avg((F.col("macro_f1") <= F.col("value")).cast("double"))).alias("null_percentile"))  # one row
    return rows(found.crossJoin(place), section, value="value", ci_lo="lo", ci_hi="hi", null_percentile="null_percentile", above_noise=F.col("null_percentile") > ABOVE_NOISE)


def per_repeat(df: DataFrame, folds: DataFrame, fitted: DataFrame, y: str, score: str) -> DataFrame:
    """(repeat, macro_f1) of the decisions by each fold's own threshold."""
    judged = df.select("id", F.col(y).alias("y"), F.col(score).alias("s")).join(folds, "id").join(F.broadcast(fitted.select("repeat", "fold", "threshold")), ["repeat", "fold"])
    return judged.withColumn("p", (F.col("s") >= F.col("threshold")).cast("int")).groupBy("repeat").agg(*metrics.confusion("y", "p")).select("repeat", metrics.macro_f1().alias("macro_f1"))


def comparison(votes: DataFrame, other: DataFrame, name: str, b: int, seed: int) -> DataFrame:
    """Gain of the votes over another run's (id, y, pred) on the cases of both; labels that differ are an error."""
    both = materialise(protocol.paired(votes.select("id", "y", "pred"), other.select("id", "y", "pred")))
    found = inference.paired_bootstrap(both, "y", "other_pred", "pred", b, seed)
    exact = inference.mcnemar(both, "y", "pred", "other_pred").withColumnsRenamed({"b": "mcnemar_b", "c": "mcnemar_c", "p": "mcnemar_p"})
    at = found.crossJoin(exact).crossJoin(both.agg(F.count(F.lit(1)).alias("n_common")))  # one row each
    significant = (F.col("lo") > 0) | (F.col("hi") < 0)
    return rows(at, f"comparison.{name}", n_common="n_common", delta="delta", ci_lo="lo", ci_hi="hi", p="p", significant=significant, mcnemar_b="mcnemar_b", mcnemar_c="mcnemar_c", mcnemar_p="mcnemar_p")


def assemble(
    df: DataFrame, folds: DataFrame, axes: Mapping[str, tuple[str, str]], primary: str = "reliable", invalid: Column | None = None, others: Mapping[str, DataFrame] | None = None,
    b: int = 10_000, trials: int = 500, steps: int = thresholds.STEPS, seed: int = 0,
) -> DataFrame:
    """(section, name, value) of a run: df has id and, for each axis, the label and score that axes names.

    Sections: primary and axis.<name> (metric); operational at the median of the primary's thresholds;
    diagnostics (modal share and entropy of the decisions of the axes faithfulness and relevance, or of the
    primary where they aren't both there, share of invalid outputs, thresholds and macro-F1 by repeat with
    mean and deviation); coverage; comparison.<name> for every other run, (id, y, pred) of the primary.
    A case without a fold is counted as excluded and nothing else; a primary that axes lacks is an error."""
    if primary not in axes:
        raise ValueError(f"{primary} is none of the axes {sorted(axes)}")
    # Read by every section below, so what lies behind them, whole texts perhaps, is read once.
    broken = F.coalesce(invalid, F.lit(False)) if invalid is not None else F.lit(False)
    df = materialise(df.select("id", *dict.fromkeys(c for pair in axes.values() for c in pair), broken.alias("_invalid")))
    folds = materialise(folds.select("id", "repeat", "fold"))
    out, votes, fitted = [], {}, {}
    for name, (y, score) in axes.items():
        votes[name] = materialise(thresholds.cross_validate(df.select("id", F.col(y).alias("y"), F.col(score).alias("s")), folds, "y", "s", steps=steps))
        null = thresholds.null_distribution_drawn(df.select("id", F.col(y).alias("y")), folds, "y", trials, steps, seed)
        out.append(metric(votes[name], null, "primary" if name == primary else f"axis.{name}", b, seed))
    y, score = axes[primary]
    own = df.select("id", F.col(y).alias("y"), F.col(score).alias("s"))
    fitted = materialise(thresholds.fold_thresholds(own, folds, "y", "s", steps=steps))
    at = fitted.agg(F.percentile("threshold", 0.5).alias("t"), F.stddev_pop("threshold").alias("sd")).first()
    if at["t"] is not None:
        found = metrics.operational(votes[primary], "y", "oof_score", at["t"])
        out.append(rows(found, "operational", **{c: c for c in found.columns}))
    repeats = materialise(per_repeat(df, folds, fitted, y, score))
    spread = repeats.agg(F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("sd"))
    pair = [votes[a].select("id", F.col("pred").alias(a)) for a in ("faithfulness", "relevance") if a in votes]
    decided = pair[0].join(pair[1], "id") if len(pair) == 2 else votes[primary].select(F.col("pred").alias("faithfulness"), F.col("pred").alias("relevance"))
    out.append(rows(metrics.degeneracy(decided, "faithfulness", "relevance"), "diagnostics", const_share="const_share", output_entropy="output_entropy", is_degenerate="is_degenerate"))
    rate = F.avg(F.col("_invalid").cast("double"))
    out.append(rows(df.agg(F.coalesce(rate, F.lit(0.0)).alias("rate")), "diagnostics", invalid_output_rate="rate"))
    out.append(rows(spread, "diagnostics", mean_per_repeat_f1="mean", sd_across_repeats="sd", operating_threshold=F.lit(at["t"]), threshold_sd=F.lit(at["sd"])))
    out.append(repeats.select(F.lit("repeats").alias("section"), F.concat(F.lit("f1."), "repeat").alias("name"), F.col("macro_f1").alias("value")))
    out.append(fitted.select(F.lit("thresholds").alias("section"), F.concat_ws(".", "repeat", "fold").alias("name"), F.col("threshold").alias("value")))
    counts = df.agg(F.count(F.lit(1)).alias("corpus")).crossJoin(votes[primary].agg(F.count(F.lit(1)).alias("n")))  # one row each
    out.append(rows(counts, "coverage", corpus_n="corpus", n="n", excluded_n=F.col("corpus") - F.col("n")))
    out += [comparison(votes[primary], other, name, b, seed) for name, other in (others or {}).items()]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every
