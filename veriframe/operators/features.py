"""Feature rows of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: Phrases of the rules; fixed values.
VERIFICATION = ("я проверил", "мы проверили", "проверено", "я рассчитал", "мы рассчитали", "я выполнил", "мы выполнили")
REDIRECT = ("посмотрите в статье", "перейдите по ссылке", "информация доступна по ссылке", "обратитесь к оператору")
REVEALS = ("я искусственный интеллект", "я являюсь ии", "как языковая модель", "я чат-бот")
VERIFICATION_2 = ("я проверил", "я проверила", "мы проверили", "проверил информацию", "проверила информацию", "i checked", "i verified")
REDIRECT_2 = ("обратитесь в поддержку", "обратитесь к оператору", "свяжитесь с поддержкой", "позвоните в банк", "contact support", "contact an operator")
REVEALS_2 = ("я искусственный интеллект", "я языковая модель", "как ии", "как искусственный интеллект", "as an ai", "language model")
NAVIGATION = r"(?iu)https?://|www\.|в\s+приложени[\p{L}\p{N}_]*|в\s+раздел[\p{L}\p{N}_]*|по\s+ссылк[\p{L}\p{N}_]*|стать[еия][\p{L}\p{N}_]*"


def surface(cases: DataFrame, navigation: str = NAVIGATION) -> DataFrame:
    """The nine surface features of each case."""
    a, c, q = F.col("answer"), F.col("context"), F.col("question")
    n = lambda x: F.size(t.tokens(x)).cast("double")
    return cases.select(
        "id", n(a).alias("len_answer"), n(c).alias("len_ctx"), n(q).alias("len_query"), F.size(t.chunks(c)).cast("double").alias("n_chunks"),
        t.ngram_overlap(a, c, 1).alias("overlap_ans_ctx_1"), t.ngram_overlap(a, c, 2).alias("overlap_ans_ctx_2"), t.ngram_overlap(a, q, 1).alias("overlap_ans_q_1"),
        t.digit_match(a, c).alias("digit_match_ratio"), (F.size(F.regexp_extract_all(a, F.lit(navigation), F.lit(0))) / F.greatest(F.lit(1), F.size(t.tokens(a)))).alias("url_or_nav_ratio"),
    )


def rules(cases: DataFrame, faith_at: float = 0.20, relevance_at: float = 0.10) -> DataFrame:
    """The rule-based evaluator: scores, flags and decisions of each case."""
    a = F.col("answer")
    found = cases.withColumn("_a", t.content_tokens(a))
    found = found.withColumn("context_coverage", t.coverage(t.content_tokens(F.col("context")), F.col("_a"))).withColumn("question_coverage", t.coverage(t.content_tokens(F.col("question")), F.col("_a")))
    found = found.withColumn("number_support", t.number_support(F.col("context"), a)).withColumn("faith_score", F.lit(0.70) * F.col("context_coverage") + F.lit(0.30) * F.col("number_support"))
    found = found.withColumn("false_verification", t.contains_any(a, VERIFICATION)).withColumn("redirect_only", t.contains_any(a, REDIRECT)).withColumn("reveals_ai", t.contains_any(a, REVEALS))
    f = ((F.col("faith_score") >= faith_at) & ~F.col("false_verification")).cast("int")
    r = ((F.col("question_coverage") >= relevance_at) & ~F.col("redirect_only") & ~F.col("reveals_ai")).cast("int")
    return found.withColumn("faithfulness_pred", f).withColumn("relevance_pred", r).withColumn("invalid_output", F.lit(False)).drop("_a")


def lexical(cases: DataFrame) -> DataFrame:
    """The fourteen features of the second rule set."""
    words = lambda x: t.tokens(x, t.PLAIN_WORD)
    a, q, c = F.col("answer"), F.col("question"), F.col("context")
    sets = cases.select("id", "answer", "question", "context", words(a).alias("wa"), words(q).alias("wq"), words(c).alias("wc"), words(t.latest_question(q)).alias("wl"))
    d = lambda n: F.array_distinct(F.col(n))
    flag = lambda phrases: t.contains_any(t.collapse(a), phrases).cast("int")
    return sets.select(
        "id", t.coverage(d("wc"), d("wa")).alias("context_coverage"), t.coverage(d("wq"), d("wa")).alias("full_question_coverage"), t.coverage(d("wl"), d("wa")).alias("latest_question_coverage"),
        t.jaccard(d("wc"), d("wa")).alias("context_answer_jaccard"), t.jaccard(d("wq"), d("wa")).alias("question_answer_jaccard"), t.jaccard(d("wl"), d("wa")).alias("latest_question_answer_jaccard"),
        t.number_support(c, a, dotted=True).alias("number_support"), F.size("wa").alias("answer_token_count"), F.size("wq").alias("question_token_count"), F.size("wc").alias("context_token_count"),
        F.when(F.size("wq") > 0, F.size("wa") / F.size("wq")).otherwise(F.lit(0.0)).alias("answer_question_length_ratio"),
        flag(VERIFICATION_2).alias("false_verification"), flag(REDIRECT_2).alias("redirect_only"), flag(REVEALS_2).alias("reveals_ai_identity"),
    )


def prompt_pair(cases: DataFrame, target: Column) -> DataFrame:
    """(id, prompt, completion) for fine-tuning."""
    return cases.select("id", F.concat(F.lit("Question:\n"), "question", F.lit("\n\nContext:\n"), "context", F.lit("\n\nAnswer:\n"), "answer").alias("prompt"), target.alias("completion"))


def direct_target(faithfulness: Column, relevance: Column) -> Column:
    return F.concat(F.lit('{"faithfulness": '), faithfulness.cast("string"), F.lit(', "relevance": '), relevance.cast("string"), F.lit("}"))


def axis_target(label: Column, axis: str, marker: Column) -> Column:
    return F.concat(F.lit("MARKER: "), marker, F.lit(f"\n{axis}: "), F.when(label == 1, "PASS").otherwise("FAIL"))
