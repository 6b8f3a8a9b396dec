"""A judge asked about every chunk of a case: a table function, one row for each chunk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as t
from .grounding import chunk_scores

#: (question, answer, chunk) triples to a score each.
Scorer = Callable[[Sequence[tuple[str, str, str]]], Sequence[float]]
BATCH = 16


def judged_chunks(cases: DataFrame, scorer: Scorer, batch: int = BATCH, key: str = "id") -> DataFrame:
    """(key, chunk, score, error): the judge's score of each chunk, from 1, of cases with question, answer and context.

    scorer runs in tasks, on up to batch chunks of a case at a time. Where it raises, or gives another number of
    scores, it is asked about each of them alone: what fails then has no score but the error's text, and the
    others of the batch keep theirs. A null text is an empty one; a case without chunks has no rows; repeated
    cases have rows each."""
    if batch < 1:
        raise ValueError("a batch has one chunk at least")

    class Judge:
        def eval(self, question: str, answer: str, chunks: list):
            for i in range(0, len(chunks), batch):
                asked = [(question, answer, c) for c in chunks[i : i + batch]]
                try:
                    scores = [(float(s), None) for s in scorer(asked)]
                    if len(scores) != len(asked):
                        raise ValueError(f"{len(scores)} scores for {len(asked)} chunks")
                except Exception:
                    scores = [self.alone(x) for x in asked]
                for j, (score, error) in enumerate(scores):
                    yield i + j + 1, score, error

        @staticmethod
        def alone(asked: tuple[str, str, str]) -> tuple:
            try:
                (score,) = scorer([asked])
                return float(score), None
            except Exception as error:
                return None, f"{type(error).__name__}: {error}"

    judge = udtf(Judge, returnType="chunk int, score double, error string")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    given = cases.select(F.col(key), text("question"), text("answer"), t.chunks(F.coalesce(F.col("context"), F.lit(""))).alias("chunks"))
    return given.lateralJoin(judge(F.col("question").outer(), F.col("answer").outer(), F.col("chunks").outer())).select(key, "chunk", "score", "error")


def by_case(judged: DataFrame, key: str = "id") -> DataFrame:
    """(key, n_chunks, n_failed, and chunk_scores() of the chunks that have a score, null where none has)."""
    scores = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "score"))), lambda x: x["score"]), lambda s: s.isNotNull())
    each = judged.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.count("error").alias("n_failed"), scores.alias("scores"))
    return each.select(key, "n_chunks", "n_failed", F.when(F.size("scores") > 0, chunk_scores(F.col("scores"))).alias("c")).select(key, "n_chunks", "n_failed", "c.*")
