"""Tables of a comparison: what more samples of a judge buy, and methods by their value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import diagnostics, metrics

SIZES = (1, 4, 8, 16)


def median(values: Column) -> Column:
    """Of an array of numbers; the mean of the middle two where their number is even."""
    high = F.sort_array(values)
    at = lambda k: F.get(high, F.floor(k).cast("int"))
    return (at((F.size(values) - 1) / 2) + at(F.size(values) / 2)) / 2


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def ablation(samples: DataFrame, labels: DataFrame, axis: str, temperature: float, sizes: Sequence[int] = SIZES) -> DataFrame:
    """(axis, temperature, n, aggregation, cases, auc, lo, hi, pass_rate, sure_share, cost, line): for the first n samples of
    each case, joined by mean, median and share of PASS votes, how well the score ranks, with DeLong's interval, and its
    cost in samples a case; line is a row of the Markdown table.

    samples has (case_id, k, prob, vote), k from 1; labels has (case_id, y), y 0 or 1. A case of fewer samples than the
    largest size is an error, as is one whose samples are not numbered from 1 one by one. Null votes don't vote, without votes the share
    is 1/2; cases without label or samples are left out; no cases, no rows. A case's samples are one array."""
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 1:
        raise ValueError("sizes are whole numbers from 1")
    one = F.struct(F.col("k").cast("int").alias("k"), F.col("prob").cast("double").alias("prob"), F.col("vote").cast("double").alias("vote"))
    by_case = samples.groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    whole = F.transform(F.slice("s", 1, sizes[-1]), lambda x: x["k"]) == F.sequence(F.lit(1), F.lit(sizes[-1]))
    short = F.raise_error(F.concat(F.lit(f"not {sizes[-1]} samples: "), F.col("case_id").cast("string"))).cast("array<struct<k:int,prob:double,vote:double>>")
    by_case = by_case.select("case_id", F.when(whole, F.col("s")).otherwise(short).alias("s"))

    def scores(n: int) -> list[Column]:
        first = F.slice("s", 1, n)
        probs, votes = F.transform(first, lambda x: x["prob"]), F.filter(F.transform(first, lambda x: x["vote"]), lambda v: v.isNotNull())
        share = F.when(F.size(votes) > 0, mean(votes)).otherwise(0.5)
        return [F.struct(F.lit(n).alias("n"), F.lit(name).alias("aggregation"), value.alias("p")) for name, value in (("mean_prob", mean(probs)), ("median_prob", median(probs)), ("vote_share", share))]

    each = by_case.join(labels.select("case_id", F.col("y").cast("int").alias("y")), "case_id").where("y is not null")
    long = each.select("y", F.explode(F.array(*[s for n in sizes for s in scores(n)])).alias("e")).select("y", F.col("e.n").alias("size"), "e.aggregation", "e.p")
    by = ["size", "aggregation"]
    said = long.groupBy(*by).agg(F.avg((F.col("p") > diagnostics.PASS).cast("double")).alias("pass_rate"), F.avg((F.col("p") > diagnostics.SURE).cast("double")).alias("sure_share"))
    rows = metrics.auc_interval(long, "p", "y", by).join(said, by)
    shown = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))).otherwise("-")
    share = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    cells = F.concat_ws(" | ", F.lit(axis), F.format_string("%.1f", F.lit(float(temperature))), F.col("size").cast("string"), "aggregation",
        F.concat(F.format_string("%.3f", "auc"), F.lit(" ["), shown("lo"), F.lit(", "), shown("hi"), F.lit("]")), share("pass_rate"), share("sure_share"), F.col("size").cast("string"))
    return rows.select(
        F.lit(axis).alias("axis"), F.lit(float(temperature)).alias("temperature"), F.col("size").alias("n"), "aggregation", F.col("n").alias("cases"),
        "auc", "lo", "hi", "pass_rate", "sure_share", F.col("size").alias("cost"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"),
    )


def leaderboard(values: DataFrame, kinds: Sequence[tuple[str, str]] = (), other: str = "other") -> DataFrame:
    """(place, method, kind, value): methods by falling value, ties by name, nulls last. kind is that of the first
    beginning in kinds, pairs (beginning, kind), that the name has. One row a method: there are few."""
    kind = F.lit(other)
    for start, name in reversed(kinds):
        kind = F.when(F.startswith("method", F.lit(start)), name).otherwise(kind)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("value").desc_nulls_last(), "method"))
    return values.select(place.alias("place"), "method", kind.alias("kind"), "value")
