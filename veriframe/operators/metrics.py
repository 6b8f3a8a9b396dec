"""Classification metrics as aggregations: one pass, nothing but counts leaves a task.

Curves work on counts by distinct score; their running sums are dealt over ranges of scores, so no task
holds all distinct scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def confusion(y: str, p: str) -> list[Column]:
    """Aggregates tn, fp, fn, tp with 1 as the positive class."""
    one = lambda a, b, name: F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(name)
    return [one(0, 0, "tn"), one(0, 1, "fp"), one(1, 0, "fn"), one(1, 1, "tp")]


def f1_negative() -> Column:
    return ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn"))


def f1_positive() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def macro_f1() -> Column:
    """Mean of both classes' F1; a class on neither side counts 0."""
    return (f1_negative() + f1_positive()) / 2


def macro_f1_present() -> Column:
    """As macro_f1, over the classes that are on some side only."""
    n0, n1 = (F.col("tn") + F.col("fp") + F.col("fn") > 0).cast("int"), (F.col("tp") + F.col("fp") + F.col("fn") > 0).cast("int")
    return ratio(f1_negative() * n0 + f1_positive() * n1, n0 + n1)


def recall() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def specificity() -> Column:
    return ratio(F.col("tn"), F.col("tn") + F.col("fp"))


def youden() -> Column:
    return recall() + specificity() - 1


def evaluation(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: F1 of each axis and of both together, share of invalid outputs, totals.

    gold (id, faithfulness, relevance) must each have one prediction; others are ignored."""
    joined = gold.select("id", "faithfulness", "relevance").join(predictions.select("id", "faithfulness_pred", "relevance_pred", "invalid_output"), "id", "left")
    joined = joined.withColumn("faithfulness_pred", F.coalesce("faithfulness_pred", F.raise_error(F.concat(F.lit("no prediction for "), "id")).cast("int")))
    joined = joined.withColumn("reliable", F.col("faithfulness") * F.col("relevance")).withColumn("reliable_pred", F.col("faithfulness_pred") * F.col("relevance_pred"))
    axes = ("faithfulness", "relevance", "reliable")
    named = [c.alias(f"{a}_{n}") for a in axes for c, n in zip(confusion(a, f"{a}_pred"), ("tn", "fp", "fn", "tp"), strict=True)]
    counts = joined.agg(F.count(F.lit(1)).alias("total"), F.count_if("invalid_output").alias("invalid"), *named)

    def f1(a: str) -> Column:
        tn, fp, fn, tp = (F.col(f"{a}_{n}") for n in ("tn", "fp", "fn", "tp"))
        n0, n1 = (tn + fp + fn > 0).cast("int"), (tp + fp + fn > 0).cast("int")
        return ratio(ratio(2 * tn, 2 * tn + fp + fn) * n0 + ratio(2 * tp, 2 * tp + fp + fn) * n1, n0 + n1)

    return counts.select("total", "invalid", ratio(F.col("invalid"), F.col("total")).alias("invalid_rate"), *[f1(a).alias(f"macro_f1_{a}") for a in axes])


def marker_f1(pairs: DataFrame, gold: str = "marker", pred: str = "marker_pred") -> DataFrame:
    """(marker, support, predicted, hits, f1) of every marker on either side; a missing prediction is `unknown`."""
    counts = pairs.groupBy(F.col(gold).alias("g"), F.coalesce(pred, F.lit("unknown")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = counts.select(F.col("g").alias("marker"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("hits"))
    other = counts.select(F.col("p").alias("marker"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hits"))
    sums = side.unionByName(other).groupBy("marker").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    return sums.withColumn("f1", ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")))


def marker_quality(pairs: DataFrame, known: Sequence[str], gold: str = "marker", pred: str = "marker_pred", silent: Sequence[str] = ("none", "unknown")) -> DataFrame:
    """One row: n, n_unknown predictions outside known, macro-F1 over markers of either side, of gold, and of
    gold less the silent ones; of rows whose gold isn't silent their number and how many are hit."""
    each = marker_f1(pairs, gold, pred)
    loud, there = ~F.col("marker").isin(*silent), F.col("support") > 0
    return each.agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("marker").isin(*known), F.col("predicted"))), F.lit(0)).alias("n_unknown"),
        F.avg("f1").alias("f1_either"), F.avg(F.when(there, F.col("f1"))).alias("f1_gold"), F.avg(F.when(there & loud, F.col("f1"))).alias("f1_explicit"),
        F.coalesce(F.sum(F.when(loud, F.col("support"))), F.lit(0)).alias("n_explicit"), F.coalesce(F.sum(F.when(loud, F.col("hits"))), F.lit(0)).alias("explicit_hits"),
    )


def score_counts(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, s, n, pos): rows and positives of each distinct score."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))


#: Ranges that running sums are dealt over.
RANGES = 64


def below(counts: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """counts with below_<c> for each c of sums: its sum over rows of a lower order value and equal by.

    The order is a number, distinct within by; null is lowest. Ranges are cut at its rough quantiles: a
    running sum is one over the ranges' totals, RANGES rows for each by, and one inside each range."""
    counts = materialise(counts)
    cuts = sorted(set(counts.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    ranged = counts.withColumn("_range", F.coalesce(place, F.lit(0)))
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    over = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_range"]
    starts = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_start_{c}") for c in sums])
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_inside_{c}") for c in sums])
    both = runs.join(starts, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]))
    return both.select(*counts.columns, *[(F.col(f"_start_{c}") + F.col(f"_inside_{c}")).alias(f"below_{c}") for c in sums])


def roc_auc(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, n_pos, auc): the chance that a positive scores over a negative, ties counting half; null with one class."""
    lower = below(score_counts(df, score, y, by).withColumn("neg", F.col("n") - F.col("pos")), "s", ["neg"], by)
    agg = lower.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("wins"))
    return agg.select(*by, "n", "n_pos", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / F.greatest(F.col("n_pos") * F.col("n_neg"), F.lit(1))).alias("auc"))


#: Half the width of a 95 % interval, in standard deviations.
Z95 = 1.959963984540054


def auc_interval(df: DataFrame, score: str, y: str, by: Sequence[str]) -> DataFrame:
    """(by, n, n_pos, auc, lo, hi): ROC-AUC with DeLong's 95 % interval, cut to [0, 1], from counts by score.

    With one class the area is 1/2 and the interval null; so is the interval where a class has one row.
    Groups with a null in by are left out."""
    counts = materialise(below(score_counts(df, score, y, by).withColumn("neg", F.col("n") - F.col("pos")), "s", ["neg", "pos"], by))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    joined = counts.select(*by, "pos", "neg", "below_pos", "below_neg").join(whole, list(by))
    beaten = ratio(F.col("below_neg") + F.col("neg") / 2, F.col("n_neg"))
    beaten_by = 1 - ratio(F.col("below_pos") + F.col("pos") / 2, F.col("n_pos"))
    mean = lambda w, x, n: ratio(F.sum(F.col(w) * x), F.col(n))
    means = joined.withColumns({"x": beaten, "z": beaten_by}).groupBy(*by, "n", "n_pos", "n_neg").agg(mean("pos", F.col("x"), "n_pos").alias("auc"), F.sum(F.col("neg") * F.col("z") / F.greatest("n_neg", F.lit(1))).alias("mean_z"))
    off = joined.withColumns({"x": beaten, "z": beaten_by}).join(means.select(*by, "auc", "mean_z"), list(by))
    spread = off.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("x") - F.col("auc")) ** 2).alias("sx"), F.sum(F.col("neg") * (F.col("z") - F.col("mean_z")) ** 2).alias("sz"))
    out = means.join(spread, list(by))
    enough = (F.col("n_pos") > 1) & (F.col("n_neg") > 1)
    sd = F.sqrt(ratio(F.col("sx"), F.col("n_pos") * (F.col("n_pos") - 1)) + ratio(F.col("sz"), F.col("n_neg") * (F.col("n_neg") - 1)))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("auc")).otherwise(F.lit(0.5))
    return out.select(*by, "n", "n_pos", auc.alias("auc"), F.when(enough, F.greatest(F.col("auc") - Z95 * sd, F.lit(0.0))).alias("lo"), F.when(enough, F.least(F.col("auc") + Z95 * sd, F.lit(1.0))).alias("hi"))


def precision_recall(df: DataFrame, score: str, y: str) -> DataFrame:
    """(s, flagged, hits, precision, recall, step) at each distinct score, rows of that score or more flagged."""
    counts = materialise(below(score_counts(df, score, y), "s", ["n", "pos"]))
    whole = F.broadcast(counts.agg(F.sum("n").alias("rows"), F.sum("pos").alias("all")))
    runs = counts.crossJoin(whole).select("s", (F.col("rows") - F.col("below_n")).alias("flagged"), (F.col("all") - F.col("below_pos")).alias("hits"), "all", "pos")  # whole is one row
    return runs.select("s", "flagged", "hits", (F.col("hits") / F.col("flagged")).alias("precision"), ratio(F.col("hits"), F.col("all")).alias("recall"), ratio(F.col("pos"), F.col("all")).alias("step"))


def operational(df: DataFrame, y: str, score: str, threshold: float, precisions: Sequence[float] = (0.5, 0.6, 0.7)) -> DataFrame:
    """One row on finding the unreliable: ROC-AUC, average precision by steps, base rate, lift, recall at
    precisions, share flagged and the confusion at a threshold. The risk of a row is 1 - score."""
    risk = df.select((1 - F.col(y)).alias("bad"), (1 - F.col(score)).alias("risk"), (F.col(score) < threshold).cast("int").alias("flag"))
    at = F.broadcast(risk.agg(*confusion("bad", "flag"), F.count(F.lit(1)).alias("n"), F.avg(F.col("bad").cast("double")).alias("base_rate")))
    curve = precision_recall(risk, "risk", "bad")
    reach = [F.coalesce(F.max(F.when(F.col("precision") >= p, F.col("recall"))), F.lit(0.0)).alias(f"recall_at_{int(100 * p)}") for p in precisions]
    ap = curve.agg(F.sum(F.col("step") * F.col("precision")).alias("pr_auc"), *reach)
    auc = roc_auc(risk, "risk", "bad").select("auc")
    out = at.crossJoin(ap).crossJoin(auc)  # one row each
    return out.select(
        "n", F.col("auc").alias("roc_auc"), "pr_auc", "base_rate", ratio(F.col("pr_auc"), F.col("base_rate")).alias("lift"), *[f"recall_at_{int(100 * p)}" for p in precisions],
        ((F.col("fp") + F.col("tp")) / F.col("n")).alias("flagged_share"), "tn", "fp", "fn", "tp",
    )


def degeneracy(df: DataFrame, f: str, r: str, by: Sequence[str] = (), most: float = 0.98) -> DataFrame:
    """(by, const_share, output_entropy, is_degenerate) of pairs of decisions."""
    counts = df.groupBy(*by, f, r).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    agg = counts.withColumn("share", share).groupBy(*by).agg(F.max("share").alias("const_share"), (-F.sum(F.col("share") * F.log2("share"))).alias("e"))
    return agg.select(*by, "const_share", F.abs("e").alias("output_entropy"), (F.col("const_share") > most).alias("is_degenerate"))


def kappa() -> Column:
    """Cohen's, from tn, fp, fn, tp of two raters."""
    n = (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).cast("double")
    seen = (F.col("tn") + F.col("tp")) / n
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("tn") + F.col("fn")) * (F.col("tn") + F.col("fp"))) / (n * n)
    return F.when(chance == 1, F.lit(0.0)).otherwise((seen - chance) / F.when(chance == 1, F.lit(1.0)).otherwise(1 - chance))
