import pytest
from pyspark.sql import functions as F

from veriframe.functions import text
from veriframe.functions.feedback import feedback, snippet
from veriframe.operators import tables


def told(spark, row, axis="FAITHFULNESS", **more):
    df = spark.createDataFrame([row], "gold int, pred int, answer string, context string, question string, marker string")
    return df.select(feedback(axis, *map(F.col, df.columns), **more)).first()[0]


def test_feedback_names_the_fault_and_the_place(spark):
    ctx = "[CHUNK 1] кредит выдают\n[Чанк 7] карту блокируют сразу [CHUNK 9] карту блокируют"
    assert told(spark, (1, 1, "a", ctx, "q", "none")) == "Верно."
    assert told(spark, (0, 1, "Карту  блокируют\nзавтра", ctx, "q", "x"), gloss={"x": "выдумка"}) == (
        "Ошибка. Правильный ответ: FAITHFULNESS=FAIL. Тип ошибки: выдумка. Фрагмент ответа: «Карту блокируют завтра». В чанках это не подтверждается: ближайший по лексике — чанк 7."
    )
    assert told(spark, (1, None, "нет", ctx, "q", "y"), gloss={"x": "выдумка"}).endswith("Формат вывода обязателен. Тип ошибки: y. Фрагмент ответа: «нет». Этот фрагмент опирается на [CTX]: ни один чанк лексически не пересекается с этим фрагментом.")
    assert told(spark, (1, 0, None, " ", "Клиент: раз\nОператор: да\nКлиент: два", None), "RELEVANCE") == "Ошибка. Правильный ответ: RELEVANCE=PASS. Фрагмент ответа: «». Вопрос клиента: «два»."
    assert told(spark, (1, 0, "a", None, "просто", None), "RELEVANCE").endswith("Вопрос клиента: «просто».")
    assert told(spark, (1, 0, "a", None, None, None)) == "Ошибка. Правильный ответ: FAITHFULNESS=PASS. Фрагмент ответа: «a»."
    assert told(spark, (None, 0, "a", None, None, None)) is None
    assert spark.range(1).select(snippet(F.lit("ab cd  ef"), 6)).first()[0] == "ab cd…"


def test_assistants_of_other_names_are_given_as_roles(spark):
    one = spark.range(1).select(F.lit("Клиент: a\nBot+: b").alias("d"))
    assert one.select(text.last_client_turn(F.col("d"))).first()[0] == "a\nBot+: b"
    assert one.select(text.last_client_turn(F.col("d"), (*text.ROLES, "Bot+"))).first()[0] == "a"


def test_ablation_rows_and_their_faults(spark):
    rows = [(c, k, p, v) for c, ps in {"a": [0.9, 0.2], "b": [0.1, 0.4], "c": [0.8, 0.8], "z": [0.5, 0.5]}.items() for k, (p, v) in enumerate(zip(ps, [1, None]), 1)]
    samples = spark.createDataFrame(rows, "case_id string, k int, prob double, vote int")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("z", None), ("no", 1)], "case_id string, y int")
    got = {(r["n"], r["aggregation"]): r for r in tables.ablation(samples, labels, "REL", 0.7, (2, 1, 1)).collect()}
    assert len(got) == 6 and {r["cases"] for r in got.values()} == {3}
    assert got[2, "mean_prob"]["auc"] == 1 and got[2, "mean_prob"]["pass_rate"] == pytest.approx(2 / 3) and got[2, "vote_share"]["auc"] == 0.5
    assert got[1, "median_prob"]["line"] == "| REL | 0.7 | 1 | median_prob | 1.000 [-, -] | 66.7% | 0.0% | 1 |"
    with pytest.raises(Exception, match="not 3 samples"):
        tables.ablation(samples, labels, "REL", 0.7, (3,)).collect()
    assert tables.ablation(samples.limit(0), labels, "REL", 0.7).collect() == []


def test_leaderboard_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("m3_b", 0.5), ("m3_a", 0.5), ("x", None), ("top", 0.9)], "method string, value double")
    assert [tuple(r)[:3] for r in tables.leaderboard(df, [("m3", "judge"), ("m", "no")]).orderBy("place").collect()] == [(1, "top", "other"), (2, "m3_a", "judge"), (3, "m3_b", "judge"), (4, "x", "other")]
