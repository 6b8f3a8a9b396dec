"""Methods by name: what each needs, which score keys it gives, and how it scores cases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from . import features, guards, learned, score_expr

SURFACE = ("len_answer", "len_ctx", "len_query", "n_chunks", "overlap_ans_ctx_1", "overlap_ans_ctx_2", "overlap_ans_q_1", "digit_match_ratio", "url_or_nav_ratio")
#: Words of a stand-in judge; fixed values.
UNSURE = ("не знаю", "не могу ответить", "i don't know")


@dataclass(frozen=True)
class Method:
    """score takes cases and, for methods that learn, folds; it gives (id, scores)."""

    name: str
    family: str
    keys: tuple[str, ...]
    score: Callable[[DataFrame, DataFrame | None], DataFrame]
    learns: bool = False


def score_rows(df: DataFrame, **keys: Column) -> DataFrame:
    """(id, scores) with a key of the map for each column; `__` in a name stands for the dot."""
    return df.select("id", F.create_map(*[x for k, c in keys.items() for x in (F.lit(k.replace("__", ".")), c.cast("double"))]).alias("scores"))


def by_rules(cases: DataFrame, folds: DataFrame | None) -> DataFrame:
    return score_rows(features.rules(cases), ind__p_faith=F.col("faith_score"), ind__p_rel=F.col("question_coverage"))


def by_surface(cases: DataFrame, folds: DataFrame | None) -> DataFrame:
    x = features.surface(cases).join(cases.select("id", "faithfulness", "relevance"), "id")
    f, r = (learned.oof_logistic(x, folds, SURFACE, y).withColumnRenamed("p", p) for y, p in (("faithfulness", "f"), ("relevance", "r")))
    return score_rows(f.join(r, "id"), surf__p_faith=F.col("f"), surf__p_rel=F.col("r"))


def by_majority(cases: DataFrame, folds: DataFrame | None) -> DataFrame:
    """The share of positives among the other folds' cases, averaged over repeats."""
    placed = cases.select("id", "faithfulness", "relevance").join(folds, "id")
    sums = lambda by: placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("faithfulness").alias("f"), F.sum("relevance").alias("r"))
    own, whole = sums(["repeat", "fold"]), sums(["repeat"]).toDF("repeat", "wn", "wf", "wr")
    rest = F.greatest(F.col("wn") - F.col("n"), F.lit(1))
    rates = own.join(whole, "repeat").select("repeat", "fold", ((F.col("wf") - F.col("f")) / rest).alias("pf"), ((F.col("wr") - F.col("r")) / rest).alias("pr"))
    mean = placed.join(rates, ["repeat", "fold"]).groupBy("id").agg(F.avg("pf").alias("pf"), F.avg("pr").alias("pr"))
    return score_rows(mean, maj__p_faith=F.col("pf"), maj__p_rel=F.col("pr"))


def by_keywords(cases: DataFrame, folds: DataFrame | None) -> DataFrame:
    """A stand-in judge: an answer that is not in its context is not faithful, one that gives up not relevant."""
    inside = F.contains(F.lower("context"), F.lower("answer")) & (F.col("answer") != "")
    return score_rows(cases, prompt__p_faith=inside.cast("double"), prompt__p_rel=(~contains_any(F.col("answer"), UNSURE)).cast("double"))


METHODS = {
    m.name: m
    for m in (
        Method("rules", "rules", ("ind.p_faith", "ind.p_rel"), by_rules), Method("surface", "learned", ("surf.p_faith", "surf.p_rel"), by_surface, True),
        Method("majority", "baseline", ("maj.p_faith", "maj.p_rel"), by_majority, True), Method("keywords", "stand-in", ("prompt.p_faith", "prompt.p_rel"), by_keywords),
    )
}


def resolve(names: str) -> list[Method]:
    """`all`, or names with commas between; one that isn't known is an error."""
    wanted = list(METHODS) if names == "all" else [n.strip() for n in names.split(",")]
    unknown = [n for n in wanted if n not in METHODS]
    if unknown:
        raise ValueError(f"methods not known: {unknown}; there are {sorted(METHODS)}")
    return [METHODS[n] for n in wanted]


def run(name: str, cases: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """(id, scores) of a method. Methods that learn score only cases with a fold."""
    method = resolve(name)[0]
    if method.learns and folds is None:
        raise ValueError(f"{name} learns and needs folds")
    return method.score(cases, folds)


def require_contract(name: str, scores: DataFrame) -> None:
    """An error unless ids are distinct and every row has the method's keys with finite values."""
    r = guards.contract(scores, resolve(name)[0].keys).first()
    if r["n"] != r["n_ids"] or r["n_lacking"] or r["n_not_finite"] or r["n_bad_keys"]:
        raise ValueError(f"scores of {name} break their contract: {r.asDict()}")


def combined(scores: DataFrame) -> DataFrame:
    """(id, score): the product of both axes."""
    return scores.select("id", score_expr.default_score(F.col("scores")).alias("score"))
