"""Text functions and feature rows over cases and dialogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import text as t
from ..operators import converters, features
from .registry import query
from .views import CASES, MARKED, cases, marked_cases, table, with_

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[ \t\n\x0B\f\r]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def words(x: str, pattern: str = WORD) -> str:
    return f"regexp_extract_all(lower({x}), '{pattern}')"


def runs(ws: str, n: int) -> str:
    return f"(case when len({ws}) < {n} then []::varchar[] else list_transform(range(1, len({ws}) - {n} + 2), lambda i: array_to_string({ws}[i:i + {n} - 1], ' ')) end)"


def share_in(a: str, b: str) -> str:
    return f"(len(list_filter({a}, lambda g: list_contains({b}, g))) / len({a}))"


def overlap(a: str, b: str, n: int, runs_a: str = "", runs_b: str = "") -> str:
    return f"(case when len({a}) = 0 then 0.0 when len({a}) < {n} then {share_in(a, b)} else {share_in(runs_a or a, runs_b or b)} end)"


def chunk_list(x: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({x}, '\\[CHUNK\\s+\\d+\\]'), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"(case when len({parts}) > 0 then {parts} when {strip(x)} <> '' then [{x}] else []::varchar[] end)"


def found_numbers(x: str) -> str:
    return f"regexp_extract_all({x}, '\\d+(?:[.,]\\d+)?')"


def plain(x: str) -> str:
    dotted = f"replace({x}, ',', '.')"
    return f"(case when contains({dotted}, '.') then regexp_replace({dotted}, '\\.?0+$', '') else {dotted} end)"


DOUBLES = "::double"


@query("t02_tokens", with_(CASES) + f"""select id, len({words('answer')}) as n_words, len({words('answer', '[A-Za-zА-Яа-яЁё0-9]+')}) as n_plain,
  len(list_distinct(list_filter({words('answer', '[A-Za-zА-Яа-яЁё0-9]+')}, lambda w: length(w) > 2 and not list_contains([{", ".join(f"'{w}'" for w in t.STOPWORDS)}], w)))) as n_content,
  len(list_distinct(list_filter({words('answer')}, lambda w: length(w) >= 4))) as n_long from cases""")  # fmt: skip
def t02(spark, sf_dir):
    a = F.col("answer")
    return cases(spark, sf_dir).select(
        "id", F.size(t.tokens(a)).alias("n_words"), F.size(t.tokens(a, t.PLAIN_WORD)).alias("n_plain"), F.size(t.content_tokens(a)).alias("n_content"), F.size(t.long_tokens(a)).alias("n_long")
    )


@query("t03_whitespace", with_(CASES) + f"select id, {strip(f"regexp_replace(lower(question), '{SPACE}', ' ', 'g')")} as normal from cases")
def t03(spark, sf_dir):
    return cases(spark, sf_dir).select("id", t.normalise(F.col("question")).alias("normal"))


@query("t01_query_key", with_(CASES) + f"select id, {strip(f"regexp_replace(regexp_replace(lower(nfc_normalize(question)), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '{SPACE}', ' ', 'g')")} as query_key from cases")
def t01(spark, sf_dir):
    return cases(spark, sf_dir).select("id", t.query_key(F.col("question")).alias("query_key"))


@query("t04_chunks", with_(CASES) + f"select id, len(cs) as n_chunks, cs[1] as first_chunk, cs[-1] as last_chunk from (select id, {chunk_list('context')} as cs from cases)")
def t04(spark, sf_dir):
    cs = cases(spark, sf_dir).select("id", t.chunks(F.col("context")).alias("cs"))
    return cs.select("id", F.size("cs").alias("n_chunks"), F.get("cs", F.lit(0)).alias("first_chunk"), F.try_element_at("cs", F.lit(-1)).alias("last_chunk"))


@query("t05_first_chunk_key", with_(CASES) + f"""select id, nullif({strip(f"regexp_replace(regexp_replace(lower(nfc_normalize(regexp_split_to_array(regexp_split_to_array(context || ' ', '\\[CHUNK 1\\]')[2], '\\[CHUNK \\d+\\]')[1])), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '{SPACE}', ' ', 'g')")}, '') as chunk_key from cases""")
def t05(spark, sf_dir):
    return cases(spark, sf_dir).select("id", t.first_chunk_key(F.col("context")).alias("chunk_key"))


@query("t06_ngram_overlap", with_(CASES, f"w as (select id, {words('answer')} as a, {words('context')} as c, {words('question')} as q from cases)",
    f"g as (select *, {runs('a', 2)} as a2, {runs('c', 2)} as c2, {runs('a', 3)} as a3, {runs('q', 3)} as q3 from w)") + f"""
  select id, round({overlap('a', 'c', 1)}, 9) as overlap_1, round({overlap('a', 'c', 2, 'a2', 'c2')}, 9) as overlap_2, round({overlap('a', 'q', 3, 'a3', 'q3')}, 9) as overlap_q3 from g""")  # fmt: skip
def t06(spark, sf_dir):
    a, c, q = F.col("answer"), F.col("context"), F.col("question")
    r = lambda x, n: F.round(x, 9).alias(n)
    return cases(spark, sf_dir).select("id", r(t.ngram_overlap(a, c, 1), "overlap_1"), r(t.ngram_overlap(a, c, 2), "overlap_2"), r(t.ngram_overlap(a, q, 3), "overlap_q3"))


@query("t07_numbers", with_(CASES) + f"select id, array_to_string({found_numbers('answer')}, ' ') as written, array_to_string(list_transform({found_numbers('answer')}, lambda n: {plain('n')}), ' ') as plain from cases")
def t07(spark, sf_dir):
    n = t.numbers(F.col("answer"))
    return cases(spark, sf_dir).select("id", F.array_join(n, " ").alias("written"), F.array_join(F.transform(n, t.plain_number), " ").alias("plain"))


PHRASES = ("the an", "die en", "le qu", "de la")


@query("t08_contains_any", with_(CASES) + "select id, (" + " or ".join(f"contains(lower(answer), '{p}')" for p in PHRASES) + ") as found from cases")
def t08(spark, sf_dir):
    return cases(spark, sf_dir).select("id", t.contains_any(F.col("answer"), PHRASES).alias("found"))


@query("t13_verdicts", with_(CASES) + """, said as (select id, 'FAITHFULNESS: ' || (case when faithfulness = 1 then 'PASS' else 'FAIL' end) || chr(10) || 'relevance: ' || (case when relevance = 1 then 'pass' else 'fail' end) || chr(10) || 'FAITHFULNESS : FAIL' as raw from cases)
  select id, case upper(list_last(regexp_extract_all(raw, '(?i)FAITHFULNESS\\s*:\\s*(PASS|FAIL)', 1))) when 'PASS' then 1 when 'FAIL' then 0 end::bigint as faithfulness_pred,
    case upper(list_last(regexp_extract_all(raw, '(?i)RELEVANCE\\s*:\\s*(PASS|FAIL)', 1))) when 'PASS' then 1 when 'FAIL' then 0 end::bigint as relevance_pred from said""")  # fmt: skip
def t13(spark, sf_dir):
    word = lambda c, p, f: F.when(F.col(c) == 1, p).otherwise(f)
    raw = F.concat(F.lit("FAITHFULNESS: "), word("faithfulness", "PASS", "FAIL"), F.lit("\nrelevance: "), word("relevance", "pass", "fail"), F.lit("\nFAITHFULNESS : FAIL"))
    said = cases(spark, sf_dir).select("id", raw.alias("raw"))
    return said.select("id", t.verdict(F.col("raw"), "FAITHFULNESS").alias("faithfulness_pred"), t.verdict(F.col("raw"), "RELEVANCE").alias("relevance_pred"))


@query("t19_content_ids", with_(CASES) + "select id, 'case_' || substr(sha1(question || chr(0) || answer), 1, 12) as case_id, sha256(answer) as answer_sha256 from cases")
def t19(spark, sf_dir):
    return cases(spark, sf_dir).select("id", numeric.case_id(F.col("question"), F.col("answer")).alias("case_id"), F.sha2("answer", 256).alias("answer_sha256"))


@query("t20_hash_unit", with_(CASES) + "select id, round(cast(cast('0x' || substr(sha256(id), 1, 16) as ubigint) as double) / 18446744073709551616.0::double, 12) as u from cases")
def t20(spark, sf_dir):
    return cases(spark, sf_dir).select("id", F.round(numeric.sha_unit(F.col("id")), 12).alias("u"))


@query("t18_cosine", """select a.vec_id, round(case when na * nb = 0 then 0.0 else dot / sqrt(na * nb) end, 6) as similarity from (
  select a.vec_id, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)) as dot,
    list_sum(list_transform(a.embedding, lambda x: x::double * x::double)) as na, list_sum(list_transform(b.embedding, lambda x: x::double * x::double)) as nb
  from embeddings a join embeddings b on b.vec_id = a.vec_id - 1) a""")  # fmt: skip
def t18(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(numeric.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("t16_t17_softmax", "select vec_id, round(1 / (1 + exp((embedding[2] - embedding[1])::double)), 9) as entail, round(1 / (1 + exp(-(embedding[3]::double))), 9) as squashed from embeddings")
def t16(spark, sf_dir):
    e = lambda i: F.get("embedding", F.lit(i))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(numeric.pair_softmax(F.lit(0.0), (e(1) - e(0)).cast("double")), 9).alias("entail"), F.round(numeric.sigmoid(e(2).cast("double")), 9).alias("squashed")
    )


@query("t21_wilson", """with c as (select lang, count(*)::double as n, count(*) filter (where n_chars > 2000)::double as k from documents group by lang), z as (select *, 1.959963984540054::double as z, k / n as p from c)
  select lang, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0.0), 9) as lo,
    round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1.0), 9) as hi from z""")  # fmt: skip
def t21(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("n_chars") > 2000).cast("double").alias("k"))
    lo, hi = numeric.wilson(F.col("k"), F.col("n"))
    return c.select("lang", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("t22_unit_grid", """with g as (select i, case when i = 100 then 1.0::double else i * 0.01::double end as t from range(101) r(i)), s as (select (n_chars % 100)::double / 99 as s from documents where n_chars is not null)
  select i as step, t, count(s) as n_at_least from g left join s on s >= t group by i, t""")  # fmt: skip
def t22(spark, sf_dir):
    """The grid's points, and how many scores reach each: a score reaches the points up to its own place among them."""
    s = table(spark, sf_dir, "documents").where("n_chars is not null").select((F.col("n_chars") % 100 / F.lit(99.0)).alias("s"))
    reached = s.select(F.size(F.filter(numeric.unit_grid(), lambda t: t <= F.col("s"))).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    each = reached.select(F.explode(F.slice(numeric.unit_grid(), F.lit(1), F.col("k"))).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n_at_least"))
    grid = spark.range(1).select(F.posexplode(numeric.unit_grid()).alias("step", "t"))
    return grid.join(each, "t", "left").select("step", "t", F.coalesce("n_at_least", F.lit(0)).alias("n_at_least"))


@query("t26_path_parts", "select cast(doc_id as varchar) as doc_id, source as method, coalesce(lang, '') as variant, case when source like 'src1%' then 'one' else 'other' end as category from documents")
def t26(spark, sf_dir):
    path = F.concat(F.lit("predictions/"), F.col("source"), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/scores.jsonl"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", path.alias("path"))
    return d.select("doc_id", t.last_path_part(F.col("path"), 3).alias("method"), t.last_path_part(F.col("path"), 2).alias("variant"), F.when(F.col("source").like("src1%"), "one").otherwise("other").alias("category"))


@query("t27_sft_targets", with_(MARKED) + """select id, '{"faithfulness": ' || faithfulness || ', "relevance": ' || relevance || '}' as direct,
  'MARKER: ' || marker || chr(10) || 'FAITHFULNESS: ' || (case when faithfulness = 1 then 'PASS' else 'FAIL' end) as axis from marked""")  # fmt: skip
def t27(spark, sf_dir):
    f = F.col("faithfulness")
    return marked_cases(spark, sf_dir).select("id", features.direct_target(f, F.col("relevance")).alias("direct"), features.axis_target(f, "FAITHFULNESS", F.col("marker")).alias("axis"))


@query("a54_truncate", with_(CASES) + "select id, case when length(question) > 40 then substr(question, 1, 40) || ' …' else question end as question, substr(context, 1, 200) as context from cases")
def a54(spark, sf_dir):
    return cases(spark, sf_dir).select("id", t.truncated(F.col("question"), 40, " …").alias("question"), t.truncated(F.col("context"), 200).alias("context"))


TEMPLATE = "Q: {question}\nA: {answer}\n"


@query("a56_prompts", with_(CASES) + "select id, sha256(replace(replace('Q: {question}' || chr(10) || 'A: {answer}' || chr(10), '{question}', question), '{answer}', answer)) as prompt_sha256 from cases")
def a56(spark, sf_dir):
    return cases(spark, sf_dir).select("id", F.sha2(t.filled(TEMPLATE, [("question", F.col("question")), ("answer", F.col("answer"))]), 256).alias("prompt_sha256"))


@query("b07_chat_export", with_(MARKED) + """select id, sha256('Question:' || chr(10) || question || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer:' || chr(10) || answer) as prompt_sha256,
  '{"faithfulness": ' || faithfulness || ', "relevance": ' || relevance || '}' as completion from marked""")  # fmt: skip
def b07(spark, sf_dir):
    m = marked_cases(spark, sf_dir)
    return features.prompt_pair(m, features.direct_target(F.col("faithfulness"), F.col("relevance"))).select("id", F.sha2("prompt", 256).alias("prompt_sha256"), "completion")


NUMBERS_A, NUMBERS_C = (f"list_transform({found_numbers(x)}, lambda n: {plain('n')})" for x in ("answer", "context"))


@query("x01_surface", with_(CASES, f"w as (select id, answer, {words('answer')} as a, {words('context')} as c, {words('question')} as q, {chunk_list('context')} as cs, {NUMBERS_A} as na, {NUMBERS_C} as nc from cases)",
    f"g as (select *, {runs('a', 2)} as a2, {runs('c', 2)} as c2 from w)") + f"""
  select id, len(a)::double as len_answer, len(c)::double as len_ctx, len(q)::double as len_query, len(cs)::double as n_chunks,
    round({overlap('a', 'c', 1)}, 9) as overlap_ans_ctx_1, round({overlap('a', 'c', 2, 'a2', 'c2')}, 9) as overlap_ans_ctx_2, round({overlap('a', 'q', 1)}, 9) as overlap_ans_q_1,
    round(case when len(na) = 0 then 1.0 else {share_in('na', 'nc')} end, 9) as digit_match_ratio,
    round(len(regexp_extract_all(answer, '(?i)https?://|www\\.')) / greatest(1, len(a)), 9) as url_or_nav_ratio from g""")  # fmt: skip
def x01(spark, sf_dir):
    f = features.surface(cases(spark, sf_dir))
    return f.select("id", *[F.round(c, 9).alias(c) if c not in ("len_answer", "len_ctx", "len_query", "n_chunks") else c for c in f.columns if c != "id"])


PLAIN = "[A-Za-zА-Яа-яЁё0-9]+"
STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)


def content(x: str) -> str:
    return f"list_distinct(list_filter({words(x, PLAIN)}, lambda w: length(w) > 2 and not list_contains([{STOP}], w)))"


def covered(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 then 0.0 else len(list_intersect({a}, {b})) / len({a}) end)"


def has(x: str, phrases) -> str:
    return "(" + " or ".join(f"contains(lower({x}), '{p}')" for p in phrases) + ")"


RULES = f"""rules_in as (select *, {content('answer')} as a, {content('context')} as c, {content('question')} as q, list_distinct({found_numbers('answer')}) as na, list_distinct({found_numbers('context')}) as nc from cases),
rules_cov as (select *, {covered('a', 'c')} as context_coverage, {covered('a', 'q')} as question_coverage, case when len(na) = 0 then 1.0 else len(list_intersect(na, nc)) / len(na) end as number_support,
  {has('answer', features.VERIFICATION)} as false_verification, {has('answer', features.REDIRECT)} as redirect_only, {has('answer', features.REVEALS)} as reveals_ai from rules_in),
rules_score as (select *, 0.70::double * context_coverage + 0.30::double * number_support as faith_score from rules_cov),
rules as (select *, case when faith_score >= 0.2::double and not false_verification then 1 else 0 end as faithfulness_pred,
  case when question_coverage >= 0.1::double and not redirect_only and not reveals_ai then 1 else 0 end as relevance_pred from rules_score)"""


@query("x02_rules", with_(CASES, RULES) + "select id, round(context_coverage, 9) as context_coverage, round(question_coverage, 9) as question_coverage, round(number_support, 9) as number_support, round(faith_score, 9) as faith_score, faithfulness_pred::bigint as faithfulness_pred, relevance_pred::bigint as relevance_pred from rules")
def x02(spark, sf_dir):
    r = features.rules(cases(spark, sf_dir))
    nine = [F.round(c, 9).alias(c) for c in ("context_coverage", "question_coverage", "number_support", "faith_score")]
    return r.select("id", *nine, "faithfulness_pred", "relevance_pred")


def jac(a: str, b: str) -> str:
    return f"(case when len({a}) + len({b}) = 0 then 1.0 else len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end)"


@query("x03_lexical", with_(CASES, f"w as (select id, {words('answer', PLAIN)} as wa, {words('question', PLAIN)} as wq, {words('context', PLAIN)} as wc, list_distinct(list_transform({found_numbers('answer')}, lambda n: replace(n, ',', '.'))) as na, list_distinct(list_transform({found_numbers('context')}, lambda n: replace(n, ',', '.'))) as nc from cases)",
    "d as (select *, list_distinct(wa) as a, list_distinct(wq) as q, list_distinct(wc) as c from w)") + f"""select id, round({covered('a', 'c')}, 9) as context_coverage, round({covered('a', 'q')}, 9) as full_question_coverage,
  round({jac('c', 'a')}, 9) as context_answer_jaccard, round({jac('q', 'a')}, 9) as question_answer_jaccard, round(case when len(na) = 0 then 1.0 else len(list_intersect(na, nc)) / len(na) end, 9) as number_support,
  len(wa) as answer_token_count, len(wq) as question_token_count, len(wc) as context_token_count, round(case when len(wq) > 0 then len(wa) / len(wq) else 0.0 end, 9) as answer_question_length_ratio from d""")  # fmt: skip
def x03(spark, sf_dir):
    f = features.lexical(cases(spark, sf_dir))
    shares = ("context_coverage", "full_question_coverage", "context_answer_jaccard", "question_answer_jaccard", "number_support")
    return f.select(
        "id", *[F.round(c, 9).alias(c) for c in shares], "answer_token_count", "question_token_count", "context_token_count", F.round("answer_question_length_ratio", 9).alias("answer_question_length_ratio")
    )


@query("f04_last_user_turn", "select conv_id, arg_max(text, turn) as last_user_turn from conversations where role = 'user' group by conv_id")
def f04(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_user_turn"))


@query("a45_a46_labels", "select doc_id, case when n_chars % 2 = 0 then 1 else 0 end::bigint as label, case when n_chars % 3 = 0 then 1 when n_chars % 3 = 1 then 0 end::bigint as coerced from documents")
def a45(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    label = converters.bool_label(F.when(F.col("n_chars") % 2 == 0, " TRUE").otherwise("0 "))
    coerced = converters.binary(F.when(F.col("n_chars") % 3 == 0, "True").when(F.col("n_chars") % 3 == 1, "false").otherwise("maybe"))
    return d.select("doc_id", label.alias("label"), coerced.alias("coerced"))


@query("a47_first_marker", with_(MARKED) + "select id, case when faithfulness = 1 and relevance = 1 then 'none' when faithfulness = 0 then marker else 'unknown' end as marker from marked")
def a47(spark, sf_dir):
    m = marked_cases(spark, sf_dir)
    written = F.when(F.col("faithfulness") == 0, F.concat(F.lit("['"), "marker", F.lit("', \"other\"]"))).otherwise("['no such code']")
    return m.select("id", converters.first_marker(converters.marker_list(written), F.col("faithfulness") * F.col("relevance")).alias("marker"))


@query("a48_numbered_context", f"""select doc_id, array_to_string(list_filter(list_transform(range(1, 9), lambda i: case when coalesce({strip("string_split(text, chr(10))[i]")}, '') = '' then '' else '[CHUNK ' || i || ']' || chr(10) || {strip("string_split(text, chr(10))[i]")} end), lambda x: x <> ''), chr(10) || chr(10)) as context from documents""")
def a48(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    wide = d.select("doc_id", *[F.get("ls", F.lit(i)).alias(c) for i, c in enumerate(converters.CHUNKS)])
    return wide.select("doc_id", converters.numbered_context().alias("context"))


@query("a49_marker_fallback", with_(MARKED) + "select id, case when length(id) % 2 = 0 then marker when faithfulness = 1 and relevance = 1 then 'none' else 'unknown' end as marker from marked")
def a49(spark, sf_dir):
    m = marked_cases(spark, sf_dir)
    given = F.when(F.length("id") % 2 == 0, F.col("marker")).when(F.length("id") % 4 == 1, F.lit(""))
    return m.select("id", converters.resolved_marker(given, F.col("faithfulness") * F.col("relevance")).alias("marker"))
