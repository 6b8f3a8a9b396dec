"""Rules of a fair comparison: folds that don't leak, thresholds that are the best of their training rows,
runs compared on the same cases, decisions left to the evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import thresholds
from .guards import fingerprint


def fold_violations(folds: DataFrame, n_folds: int) -> DataFrame:
    """(repeat, id, reason) of what is wrong with a fold table (id, repeat, fold).

    A case in several rows of a repeat, a fold that is null or not in 0 .. n_folds - 1, and, with a null
    id, a repeat of fewer than two folds, where nothing would be held out."""
    again = folds.groupBy("repeat", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("repeat", "id", F.lit("several folds").alias("reason"))
    outside = folds.where(~F.coalesce(F.col("fold").between(0, n_folds - 1), F.lit(False))).select("repeat", "id", F.lit("no such fold").alias("reason"))
    single = folds.groupBy("repeat").agg(F.count_distinct("fold").alias("n")).where("n < 2").select("repeat", F.lit(None).cast(folds.schema["id"].dataType).alias("id"), F.lit("fewer than two folds").alias("reason"))
    return again.unionByName(outside).unionByName(single)


def threshold_gaps(df: DataFrame, folds: DataFrame, used: DataFrame, y: str, score: str, steps: int = thresholds.STEPS) -> DataFrame:
    """(repeat, fold, threshold, macro_f1, gap): what each threshold of used (repeat, fold, threshold) reaches
    on the training rows of its fold, and how far that is from the best grid point; the gap is null
    where the threshold is no grid point. Every fold of folds has a row, with null where used has none."""
    own = thresholds.histogram(df.join(folds, "id"), y, score, ["repeat", "fold"], steps)
    swept = thresholds.sweep(thresholds.train_counts(own), ["repeat", "fold"], steps)
    most = swept.groupBy("repeat", "fold").agg(F.max("macro_f1").alias("most"))
    at = used.select("repeat", "fold", "threshold").join(swept.select("repeat", "fold", "threshold", "macro_f1"), ["repeat", "fold", "threshold"], "left")
    return most.join(at, ["repeat", "fold"], "left").select("repeat", "fold", "threshold", "macro_f1", (F.col("most") - F.col("macro_f1")).alias("gap"))


def require(broken: DataFrame, what: str) -> None:
    """An error that shows the first rows of broken, if it has any."""
    first = [tuple(r) for r in broken.limit(5).collect()]
    if first:
        raise ValueError(f"{what}: {first}")


def require_isolated(folds: DataFrame, n_folds: int) -> None:
    require(fold_violations(folds, n_folds), "the fold table is broken")


def require_train_optimal(df: DataFrame, folds: DataFrame, used: DataFrame, y: str, score: str, within: float = 1e-12) -> None:
    require(threshold_gaps(df, folds, used, y, score).where(F.col("gap").isNull() | (F.col("gap") > within)), "a threshold isn't the best of its training rows")


def require_same_corpus(cases: DataFrame, rows: int, content: object) -> None:
    """An error unless cases are those whose fingerprint() a fold table was made with."""
    found = fingerprint(cases).first()
    if (found["rows"], int(found["content"])) != (rows, int(content)):  # type: ignore[call-overload]
        raise ValueError(f"the folds are of another corpus: {rows} rows, {content}; here {found['rows']}, {found['content']}")


def paired(a: DataFrame, b: DataFrame, labels: Sequence[str] = ("y",), key: str = "id") -> DataFrame:
    """Cases that both runs have, with a's columns and b's as other_*; reading one whose labels differ
    between the runs is an error, for then the two were not judged by the same gold. Cases of one run
    only are left out. Null labels agree with null ones."""
    other = b.select(key, *[F.col(f"`{c}`").alias(f"other_{c}") for c in b.columns if c != key])
    both = a.join(other, key)
    same = F.forall(F.array(*[F.col(x).eqNullSafe(F.col(f"other_{x}")) for x in labels]), lambda ok: ok)
    return both.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("labels differ between runs: "), F.col(key).cast("string"))).cast("boolean")))


def scores_only(predictions: DataFrame, scores: Column, decisions: Sequence[str] = ("faithfulness_pred", "relevance_pred")) -> DataFrame:
    """predictions with their decisions set to 0 and scores merged over those they have: a method hands out
    scores, and the evaluation's thresholds decide. A null map of either side counts as an empty one."""
    none = F.create_map().cast("map<string,double>")
    old = F.coalesce(F.col("scores"), none) if "scores" in predictions.columns else none
    new = F.coalesce(scores, none)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return predictions.withColumns({**{d: F.lit(0) for d in decisions}, "scores": F.map_concat(kept, new)})


def pick_marker(p_faith: Column, p_rel: Column, faith_markers: Column, rel_markers: Column) -> Column:
    """The marker said most often on the failing axis (below 1/2) that is furthest from passing, of equals
    the first said and faithfulness first; `none` where no axis fails, `unknown` where it has no marker."""

    def most(markers: Column) -> Column:
        said = F.filter(markers, lambda m: m.isNotNull() & (m != ""))
        ranked = F.transform(F.array_distinct(said), lambda m: F.struct(F.size(F.filter(said, lambda x: x == m)).alias("n"), (-F.array_position(said, m)).alias("place"), m.alias("marker")))
        return F.coalesce(F.array_max(ranked)["marker"], F.lit("unknown"))

    first = (p_faith < 0.5) & (~(p_rel < 0.5) | (p_faith <= p_rel))
    return F.when(first, most(faith_markers)).when(p_rel < 0.5, most(rel_markers)).otherwise(F.lit("none"))


def last_rows(history: DataFrame, new: DataFrame, order: str, keep: int = 25) -> DataFrame:
    """The last keep rows of history followed by new, by order, which goes on from one to the other."""
    return history.unionByName(new).orderBy(F.col(order).desc()).limit(keep)
