"""Small inputs whose results are known."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veriframe.functions import numeric
from veriframe.functions import text as t
from veriframe.operators import converters, grounding, guards, inference, judging, metrics, score_expr


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def kind(v):
    return {str: "string", float: "double", int: "long"}.get(type(v)) or ("array<double>" if v and isinstance(v[0], float) else "array<string>")


def test_query_key(spark):
    for s in ("Как  ПОДКЛЮЧИТЬ  кэшбэк?", "\tКак,  подключить —  кэшбэк!!! "):
        assert one(spark, t.query_key(F.col("s")), s=s) == "как подключить кэшбэк"


def test_last_client_turn(spark):
    dialog = "Клиент: первый\nАссистент: ответ\nКлиент: второй вопрос\nпродолжение\nОператор: да"
    assert one(spark, t.last_client_turn(F.col("s")), s=dialog) == "второй вопрос\nпродолжение"
    assert one(spark, t.last_client_turn(F.col("s")), s="Ассистент: привет") is None


@pytest.mark.parametrize("a, b, want", [("да", "да, конечно", 1.0), ("лимит сто рублей", "в договоре лимит сто рублей в день", 1.0), ("раз два", "три четыре", 0.0), ("", "что-то", 0.0)])
def test_ngram_overlap(spark, a, b, want):
    assert one(spark, t.ngram_overlap(F.col("a"), F.col("b"), 2), a=a, b=b) == want


@pytest.mark.parametrize("a, c, want", [("нет", "150", 1.0), ("150", "150 руб", 1.0), ("300", "150", 0.0), ("7,5", "7.5", 1.0)])
def test_digit_match(spark, a, c, want):
    assert one(spark, t.digit_match(F.col("a"), F.col("c")), a=a, c=c) == want


@pytest.mark.parametrize("c, want", [("[CHUNK 1]\nа\n\n[CHUNK 2]\nб\n\n[CHUNK 3]\nв", 3), ("просто текст", 1), ("", 0), (" \n ", 0)])
def test_chunks(spark, c, want):
    assert len(one(spark, t.chunks(F.col("c")), c=c)) == want


def test_numbered_chunks_and_first_key(spark):
    c = "[CHUNK 2] один\n[ФРАГМЕНТ 7] два"
    assert [tuple(x) for x in one(spark, t.numbered_chunks(F.col("c")), c=c)] == [(2, "один"), (7, "два")]
    assert one(spark, t.first_chunk_key(F.col("c")), c="[CHUNK 1]\nПервый, чанк\nдва\n[CHUNK 2]\nx") == "первый чанк два"
    assert one(spark, t.first_chunk_key(F.col("c")), c="no chunks") is None


def slow_conditions(text):
    """Conditions by looking at every place of a text."""
    marks = [m.span() for m in re.finditer("|".join(grounding.CONDITIONS), text, re.IGNORECASE)]
    groups = [[m for m in marks[i:j]] for i, j in edges([k for k in range(1, len(marks)) if marks[k][0] - marks[k - 1][1] > grounding.GAP], len(marks))]
    numbers = lambda x: {float(f"{float(re.sub(r'[ \xa0]', '', n).replace(',', '.')):.6g}") for n in re.findall(r"\d{1,3}(?:[\s\xa0]\d{3})+|\d+(?:[.,]\d+)?", x)}
    return [(text[g[0][0] : g[-1][1]].strip(), numbers(text[g[0][0] : g[-1][1] + grounding.REACH])) for g in groups]


def edges(cuts, n):
    at = [0, *cuts, n]
    return [(a, b) for a, b in zip(at, at[1:], strict=False) if b > a]


def test_conditions_equal_a_plain_search(spark):
    rng = random.Random(4)
    words = ["если", "Не менее", "до 100 000", "от 5", "рублей", "10 %", "12,5%", "3 дня", "минимальная", "слово", "кроме", "и", " , ", "в течение", "МАКСИМАЛЬНО", "еслибы", "\n", "\ue000", "тысяча слов подряд"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", "   "]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["10% " * 6000, "", "до 5" + " слово" * 4000 + " до 6"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(-1, None)], "i long, x string")
    got = {r["i"]: r["c"] for r in df.select("i", grounding.conditions(F.col("x")).alias("c")).collect()}
    assert got[-1] == []
    for i, x in enumerate(texts):
        assert [(c["text"], set(c["numbers"])) for c in got[i]] == slow_conditions(x.replace("\ue000", "\ufffd")), x[:200]
        assert all(c["weight"] == (1.0 if c["numbers"] else 0.5) for c in got[i])


def test_coverage_of_named_chunks(spark):
    cases = spark.createDataFrame([("1", "лимит 100000", "[CHUNK 1]\nдо 100 000 рублей"), ("2", "да", "[CHUNK 1]\nпросто"), ("3", "кроме прочего", "[CHUNK 1]\nкроме"), ("4", "x", "")], "id string, answer string, context string")
    sources = spark.createDataFrame([("1", [0]), ("2", [0]), ("3", [0])], "id string, sources array<int>")
    out = {r["id"]: r for r in grounding.of_all(cases, grounding.coverage(cases, sources)).collect()}
    assert tuple(out["1"])[1:] == (1.0, 1.0, 1.0, 0.0, True)
    assert tuple(out["2"])[1:] == (0.0, 1.0, 1.0, 0.0, True)
    assert tuple(out["3"])[1:] == (1.0, 1.0, 1.0, 0.0, True)
    assert tuple(out["4"])[1:] == (None, None, None, None, False)
    for bad in ([], [0, 7], [-1]):
        with pytest.raises(Exception, match="source chunk"):
            grounding.coverage(cases, spark.createDataFrame([("1", bad)], "id string, sources array<int>")).collect()


@pytest.mark.parametrize("v, want", [([0.95, 0.8, 0.2, 0.1], (0.95, 0.5125, 0.15, 2, 1)), ([0.7] * 4, (0.7, 0.7, 0.0, 4, 1)), ([1.0, 0.0, 0.0, 0.0], (1.0, 0.25, 1.0, 1, 1)), ([0.1, 0.2, 0.9, 0.4], (0.9, 0.4, 0.5, 1, 3)), ([0.73], (0.73, 0.73, 0.0, 1, 1))])
def test_chunk_scores(spark, v, want):
    assert tuple(one(spark, grounding.chunk_scores(F.col("v")), v=v)) == pytest.approx(want)


def test_token_scores(spark):
    assert one(spark, grounding.token_scores(F.col("v")), v=[0.2, 0.8]) == [0.8, 0.5, 0.5]
    assert spark.range(1).select(grounding.token_scores(F.array().cast("array<double>")).alias("x")).first()["x"] == [0, 0, 0]


def test_cluster_entropy(spark):
    e = spark.range(1).select(grounding.cluster_entropy(F.array(F.lit(0), F.lit(0), F.lit(2), F.lit(3))).alias("x")).first()["x"]
    assert e["semantic_entropy"] == pytest.approx(-(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25))) and (e["n_clusters"], e["answer_in_top_cluster"]) == (3, 1.0)


def token(text, logprob=0.0, top=None):
    return {"token": text, "logprob": logprob, "top": top or {}}


def test_token_verdicts():
    sig = lambda x: 1 / (1 + math.exp(-x))
    whole = [token("FAITHFULNESS:"), token(" PASS", -0.1, {" PASS": -0.1, " FAIL": -2.4}), token("\n"), token("RELEVANCE:"), token(" FAIL", -0.2, {" FAIL": -0.2, " PASS": -1.7})]
    assert judging.verdict_probabilities(whole) == pytest.approx({"p_faith": sig(2.3), "p_rel": 1 - sig(1.5)})
    split = [token("FAITHFULNESS"), token(":"), token(" PA", -0.2, {" PA": -0.2, " FA": -1.8}), token("SS"), token("\n"), token("RELEVANCE:"), token(" FA", -0.3, {" FA": -0.3, " PA": -1.4}), token("IL")]
    assert judging.verdict_probabilities(split) == pytest.approx({"p_faith": sig(1.6), "p_rel": 1 - sig(1.1)})
    assert judging.pass_probability(token("PASS", 0, {"PASS": math.log(0.8)})) == pytest.approx(0.8)
    assert judging.pass_probability(token("FAIL", 0, {"FAIL": math.log(0.8)})) == pytest.approx(0.2)
    assert judging.verdict_probabilities([token("no verdict")]) is None and judging.verdict_probabilities(None) is None


def test_exact_tests_and_intervals(spark):
    p = spark.range(1).select(numeric.two_sided_binomial(F.lit(31).cast("bigint"), F.lit(27).cast("bigint")).alias("p")).first()["p"]
    assert p == pytest.approx(0.6940040941)
    lo, hi = numeric.wilson(F.lit(0.0), F.lit(10.0))
    row = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert row["lo"] == 0 and row["hi"] == pytest.approx(0.27753, abs=1e-5)
    assert inference.verdict(-0.037, 0.1) == "untested" and inference.verdict(0.01, 0.1) == "supported" and inference.verdict(-0.2, -0.1) == "rejected"


def test_degenerate_and_operational(spark):
    d = metrics.degeneracy(spark.createDataFrame([(1, 1)] * 100, "f int, r int"), "f", "r").first()
    assert tuple(d) == (1.0, 0.0, True)
    o = metrics.operational(spark.createDataFrame([(y, 0.75) for y in (1, 1, 1, 0)], "y int, s double"), "y", "s", 0.5).first()
    assert (o["recall_at_50"], o["recall_at_60"], o["recall_at_70"], o["flagged_share"], o["tn"], o["fn"]) == (0, 0, 0, 0, 3, 1)


def test_bootstrap_of_equal_predictions(spark):
    df = spark.createDataFrame([(i % 2, i % 3 % 2, i % 3 % 2) for i in range(120)], "y int, a int, b int")
    r = inference.paired_bootstrap(df, "y", "a", "b", b=300).first()
    assert (r["delta"], r["p"]) == (0, 1)
    ci = inference.bootstrap_macro_f1(df, "y", "a", b=500)
    assert ci.first()["lo"] < ci.first()["value"] < ci.first()["hi"] and ci.first() == inference.bootstrap_macro_f1(df, "y", "a", b=500).first()


def test_score_expressions_refuse_all_else(spark):
    df = spark.createDataFrame([({"m.a": 2.0, "m.b": 0.0},)], "scores map<string,double>")
    assert df.select(score_expr.compile_expression("-(m.a + 1) * 2").alias("x")).first()["x"] == -6
    for bad in ("__import__('os')", "m.a ** 2", "m.a if 1 else 2", "x", "m.a +", "True"):
        with pytest.raises(ValueError):
            score_expr.compile_expression(bad)
    for fails in ("m.a / m.b", "m.c"):
        with pytest.raises(Exception, match="division by zero|no score"):
            df.select(score_expr.compile_expression(fails)).collect()


def test_guards_fail_loudly(spark):
    bad = spark.createDataFrame([("1", "q", "c", "a", 2, 0, None), ("2", "q", "c", "a", 1, 1, "no code")], "id string, question string, context string, answer string, faithfulness int, relevance int, marker string")
    assert sorted(map(tuple, guards.case_violations(bad).collect())) == [("1", "faithfulness"), ("2", "marker")]
    with pytest.raises(Exception, match="outside its domain"):
        guards.checked_cases(bad).collect()
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    with pytest.raises(ValueError, match="missing"):
        guards.require_aligned(ids, ids.limit(1))
    with pytest.raises(ValueError, match="duplicate"):
        guards.require_aligned(ids, ids.unionByName(ids))
    with pytest.raises(Exception, match="not a label"):
        spark.createDataFrame([("maybe",)], "x string").select(converters.bool_label(F.col("x"))).collect()
    assert guards.fingerprint(ids).first() == guards.fingerprint(ids.orderBy(F.desc("id"))).first()


def test_first_json_object():
    assert t.first_json('a {bad} then {"x": {"y": 1}} {"z": 2}') == '{"x": {"y": 1}}'
    assert t.first_json("none {") is None and t.first_json(None) is None


def test_organiser_rows(spark):
    row = ("Клиент: вопрос", "ответ", "один", "", None, "четыре", "", "", "", "", "True", "0", "['reason_other', 'x']")
    raw = spark.createDataFrame([row], ", ".join(f"{c} string" for c in converters.REQUIRED))
    assert converters.is_organiser(raw) and not converters.is_organiser(raw.drop("markers"))
    r = converters.organiser_cases(raw).first()
    assert (r["faithfulness"], r["relevance"], r["marker"], r["context"]) == (0, 1, "reason_other", "[CHUNK 1]\nодин\n\n[CHUNK 4]\nчетыре")
    assert r["id"].startswith("case_") and tuple(converters.marker_provenance(raw).first()) == (1, 1, 1, 0, 2)
