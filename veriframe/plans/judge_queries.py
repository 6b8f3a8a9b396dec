"""Grounding, judge outputs, groups, learned heads, sources and incremental scoring over cases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import text as t
from ..operators import features, grounding, groups, guards, judging, learned, metrics
from ..session import checkpoint_folder, materialise
from ..sources import readers, writers
from ..streaming import incremental
from .metric_queries import A, r9
from .registry import query
from .text_queries import chunk_list, strip, words
from .views import CASES, FOLDS, N_FOLDS, N_REPEATS, case_keys, cases, folds, marked_cases, scores, table, unit_sql, with_


def sentence_list(x: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([.!?…])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"(case when len({parts}) > 0 then {parts} else [{x}] end)"


def sha_unit(key: str) -> str:
    return f"(cast(cast('0x' || substr(sha256({key}), 1, 16) as ubigint) as double) / 18446744073709551616.0::double)"


PAIRS = f"""cut as (select id, answer, {sentence_list('answer')} as ss, {chunk_list('context')} as cs from cases),
sents as (select id, cs, unnest(ss) as hypothesis, generate_subscripts(ss, 1) - 1 as sent from cut),
raw_pairs as (select id, sent, hypothesis, unnest(cs) as premise, generate_subscripts(cs, 1) - 1 as chunk from sents),
pairs as (select id, sent, chunk, case when premise = hypothesis then 1.0::double else {sha_unit("'entail' || chr(0) || premise || chr(0) || hypothesis")} end as entail,
  case when premise = hypothesis then 0.0::double else (1 - {sha_unit("'entail' || chr(0) || premise || chr(0) || hypothesis")}) * {sha_unit("'contra' || chr(0) || premise || chr(0) || hypothesis")} end as contra from raw_pairs)"""
GROUNDED = PAIRS + """, per_sentence as (select id, sent, max(entail) as e, max(contra) as c, arg_max(chunk, (entail, -chunk)) as source from pairs group by id, sent)"""


@query("t10_sentences", with_(CASES) + f"select id, len({sentence_list('answer')}) as n, {sentence_list('answer')}[1] as first from cases")
def t10(spark, sf_dir):
    s = cases(spark, sf_dir).select("id", t.sentences(F.col("answer")).alias("s"))
    return s.select("id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"))


@query("j07_u08_pairs", with_(CASES, PAIRS) + """select c.id, count(p.id) as n, round(sum(entail), 6) as entail, round(sum(contra), 6) as contra, count(p.id) > 0 as grounded
  from cases c left join pairs p on p.id = c.id group by c.id""")  # fmt: skip
def j07(spark, sf_dir):
    c = cases(spark, sf_dir)
    p = grounding.pair_rows(c).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("entail"), 6).alias("entail"), F.round(F.sum("contra"), 6).alias("contra"))
    return grounding.of_all(c, p).withColumn("n", F.coalesce("n", F.lit(0)))


@query("g12_grounding", with_(CASES, GROUNDED) + """, g as (select id, round(max(e), 9) as max_entail, round(min(e), 9) as min_entail, round(avg(e), 9) as mean_entail, round(avg(c), 9) as mean_contra, round(max(c), 9) as max_contra,
  round(avg(case when e < 0.5 then 1.0::double else 0.0::double end), 9) as frac_unsupported, count(*)::double as n_sentences, count(distinct source)::double as chunk_spread from per_sentence group by id)
  select g.* exclude (id), c.id, g.id is not null as grounded from cases c left join g on g.id = c.id""")  # fmt: skip
def g12(spark, sf_dir):
    c = cases(spark, sf_dir)
    g = grounding.of_all(c, grounding.grounding(grounding.pair_rows(c)).drop("sources"))
    return r9(g, *[n for n in g.columns if n not in ("id", "n_sentences", "chunk_spread", "grounded")])


MARK = "(?i)(?:" + "|".join(grounding.CONDITIONS) + ")"
NUMBERS = "list_distinct(list_transform(regexp_extract_all({}, '\\d{{1,3}}(?:[\\s\u00a0]\\d{{3}})+|\\d+(?:[.,]\\d+)?'), lambda n: printf('%.6g', replace(regexp_replace(n, '[\\s\u00a0]', '', 'g'), ',', '.')::double)))"
COVERAGE = GROUNDED + f""", named as (select id, list_sort(list_distinct(list(source))) as sources from per_sentence group by id),
source as (select c.id, lower(c.answer) as said, {NUMBERS.format("c.answer")} as given, array_to_string(list_transform(n.sources, lambda i: c.cs[i + 1]), chr(10)) as s from cut c join named n on n.id = c.id),
marks as (select *, regexp_extract_all(s, '{MARK}') as ms, regexp_split_to_array(s, '{MARK}') as bs from source),
laid as (select *, array_to_string(list_transform(range(1, len(ms) + 1), lambda i: (case when i = 1 then '\ue000' when length(bs[i]) > {grounding.GAP} then '\ue001' || bs[i] || '\ue000' else bs[i] end) || ms[i]), '') || '\ue001' || bs[-1] as l from marks),
parts as (select id, said, given, {NUMBERS.format("s")} as numbers, case when len(ms) > 0 then string_split(l, '\ue000')[2:] else [] end as ps from laid),
found as (select *, list_transform(range(1, len(ps) + 1), lambda i: {{'text': trim(split_part(ps[i], '\ue001', 1)),
  'numbers': {NUMBERS.format(f"left(replace(array_to_string(ps[i:i + 4], ''), '{chr(0xe001)}', ''), length(split_part(ps[i], '{chr(0xe001)}', 1)) + {grounding.REACH})")}}}) as cs from parts),
open as (select *, list_filter(cs, lambda c: case when len(c.numbers) > 0 then not list_has_all(given, c.numbers) else not contains(said, lower(c.text)) end) as os from found),
x as (select id, len(cs)::double as n_conditions, case when len(cs) = 0 then 1.0::double else (len(cs) - len(os))::double / len(cs) end as cond_coverage,
  case when len(numbers) = 0 then 1.0::double else len(list_intersect(numbers, given))::double / len(numbers) end as digit_coverage,
  coalesce(list_max(list_transform(os, lambda c: case when len(c.numbers) > 0 then 1.0::double else 0.5::double end)), 0.0::double) as uncovered_max from open)
select x.* exclude (id), c.id, x.id is not null as grounded from cases c left join x on x.id = c.id"""


@query("x04_x05_coverage", with_(CASES, COVERAGE))
def x04(spark, sf_dir):
    c = cases(spark, sf_dir)
    return grounding.of_all(c, grounding.coverage(c, grounding.grounding(grounding.pair_rows(c))))


@query("g13_best_window", """with w as (select vec_id % 40 as pair, vec_id as win, embedding[1]::double as entail, embedding[2]::double as contra from embeddings)
  select pair, round(max(entail), 9) as entail, round(arg_max(contra, (entail, -win)), 9) as contra from w group by pair""")  # fmt: skip
def g13(spark, sf_dir):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    w = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("pair"), F.col("vec_id").alias("window"), e(0).alias("entail"), e(1).alias("contra"))
    return r9(grounding.best_window(w, ["pair"]), "entail", "contra")


VALUES = "list_transform(embedding[1:8], lambda x: abs(x::double))"


@query("g11_f10_chunk_scores", f"""with v as (select vec_id, {VALUES} as v from embeddings)
  select vec_id, round(list_max(v), 9) as max_chunk_score, round(list_avg(v), 9) as mean_chunk_score, round(list_reverse_sort(v)[1] - list_reverse_sort(v)[2], 9) as chunk_disagreement,
    len(list_filter(v, lambda x: x > 0.5)) as n_supporting, list_position(v, list_max(v))::bigint as argmax_chunk from v""")  # fmt: skip
def g11(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double"))).alias("v"))
    return r9(v.select("vec_id", grounding.chunk_scores(F.col("v")).alias("c")).select("vec_id", "c.*"), "max_chunk_score", "mean_chunk_score", "chunk_disagreement")


@query("g14_token_scores", f"with v as (select vec_id, {VALUES} as v from embeddings) select vec_id, round(list_max(v), 9) as max, round(list_avg(v), 9) as mean, round(len(list_filter(v, lambda x: x > 0.1)) / len(v), 9) as share from v")
def g14(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double"))).alias("v"))
    s = v.select("vec_id", grounding.token_scores(F.col("v"), 0.1).alias("s"))
    return r9(s.select("vec_id", F.get("s", F.lit(0)).alias("max"), F.get("s", F.lit(1)).alias("mean"), F.get("s", F.lit(2)).alias("share")), "max", "mean", "share")


def sampled(c):
    """Three samples a case: its question, its answer, and its first chunk or question."""
    first = F.coalesce(F.get(t.chunks(F.col("context")), F.lit(0)), F.col("question"))
    return c.withColumn("samples", F.array("question", "answer", first))


def entails(a: str, b: str) -> str:
    return f"(case when {a} = {b} then 1.0::double else {sha_unit(f"'entail' || chr(0) || {a} || chr(0) || {b}")} end)"


def contradicts(premise: str, hypothesis: str) -> str:
    return f"(case when {premise} = {hypothesis} then 0.0::double else (1 - {entails(premise, hypothesis)}) * {sha_unit(f"'contra' || chr(0) || {premise} || chr(0) || {hypothesis}")} end)"


@query("g15_j08_selfcheck", with_(CASES, f"sampled as (select id, answer, [question, answer, coalesce({chunk_list('context')}[1], question)] as samples from cases)",
    f"each as (select id, samples, unnest({sentence_list('answer')}) as hypothesis, generate_subscripts({sentence_list('answer')}, 1) as sent from sampled)",
    "flat as (select id, sent, hypothesis, unnest(samples) as premise from each)", f"per as (select id, sent, avg({contradicts('premise', 'hypothesis')}) as c from flat group by id, sent)")
    + "select id, round(avg(c), 9) as contra_mean, round(max(c), 9) as contra_max from per group by id")
def g15(spark, sf_dir):
    return r9(grounding.selfcheck(sampled(cases(spark, sf_dir))), "contra_mean", "contra_max")


@query("g16_j09_x06_entropy")
def g16(spark, sf_dir):
    return r9(grounding.selfcheck_features(sampled(cases(spark, sf_dir))), "contra_mean", "contra_max", "semantic_entropy")


@query("f09_windows", with_(CASES, f"w as (select id, {words('answer')} as ws from cases)") + """, k as (select id, ws, greatest(ceil((len(ws) - 16) / 12.0)::bigint, 0) as last from w)
  select id, len(ws) as n_tokens, last + 1 as n_windows, array_to_string(ws[last * 12 + 1 : last * 12 + 16], ' ') as last_window from k""")  # fmt: skip
def f09(spark, sf_dir):
    w = cases(spark, sf_dir).select("id", t.tokens(F.col("answer")).alias("ws"))
    w = w.withColumn("windows", grounding.windows(F.col("ws"), 16, 4))
    return w.select("id", F.size("ws").alias("n_tokens"), F.size("windows").alias("n_windows"), F.array_join(F.try_element_at("windows", F.lit(-1)), " ").alias("last_window"))


def samples_of(spark, sf_dir, n: int = 8):
    s = scores(spark, sf_dir).select(F.col("id").alias("case_id"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    prob = numeric.hash_unit(F.concat(F.lit("sample:"), "case_id", F.lit(":"), F.col("k").cast("string")))
    return s.select("case_id", F.lit("FAITHFULNESS").alias("axis"), "k", prob.alias("prob"), F.when(prob > 0.1, (prob >= 0.5).cast("int")).alias("vote"))


SAMPLES = f"samples as (select id as case_id, k, {unit_sql("'sample:' || id || ':' || k")} as prob from cases, range(1, 9) s(k))"


@query("g10_u05_votes", with_(CASES, SAMPLES) + """select case_id, 'FAITHFULNESS' as axis, round(avg(prob), 9) as mean, round(coalesce(avg(case when prob > 0.1 then (case when prob >= 0.5 then 1.0 else 0.0 end)::double end), 0.5), 9) as vote,
  round(median(prob), 9) as median, round(stddev_pop(prob), 9) as std, count(*) as n from samples group by case_id""")  # fmt: skip
def g10(spark, sf_dir):
    return r9(judging.sample_votes(samples_of(spark, sf_dir)), "mean", "vote", "median", "std")


@query("f11_prefix_means", with_(CASES, SAMPLES) + "select case_id, 'FAITHFULNESS' as axis, n, round(avg(prob), 9) as mean from samples, (select unnest([1, 4, 8])::bigint as n) where k <= n group by case_id, n")
def f11(spark, sf_dir):
    return r9(judging.prefix_means(samples_of(spark, sf_dir)), "mean")


@query("t11_t12_parsed_outputs", with_(CASES) + """select id, case when length(id) % 3 = 2 then 0 else faithfulness end::bigint as faithfulness_pred, case when length(id) % 3 = 2 then 0 else relevance end::bigint as relevance_pred,
  length(id) % 3 = 2 as invalid_output from cases""")  # fmt: skip
def t12(spark, sf_dir):
    f, r = F.col("faithfulness").cast("string"), F.col("relevance").cast("string")
    js = F.concat(F.lit('Thinking {not json} then {"faithfulness": '), f, F.lit(', "relevance": '), r, F.lit(', "marker": "none"} end'))
    raw = F.when(F.length("id") % 3 == 0, js).when(F.length("id") % 3 == 1, F.concat(F.lit("faithfulness: "), f, F.lit("\nrelevance = "), r)).otherwise("I cannot say")
    return judging.parsed_outputs(cases(spark, sf_dir).withColumn("raw_output", raw)).select("id", "faithfulness_pred", "relevance_pred", "invalid_output")


@query("t14_t15_token_verdicts", with_(CASES, A) + """select id, round(case when length(id) % 3 = 0 then p_faith when faithfulness = 1 then 0.9::double else 0.1::double end, 6) as p_faith, case when length(id) % 3 = 0 then 'logprobs' else 'regex' end as how from scores""")
def t14(spark, sf_dir):
    s = scores(spark, sf_dir)
    p = F.least(F.greatest(F.col("p_faith"), F.lit(1e-9)), F.lit(1 - 1e-9))
    top = F.create_map(F.lit(" PASS"), F.log(p), F.lit(" FAIL"), F.log(1 - p))
    none = F.create_map().cast("map<string,double>")
    token = lambda text, m: F.struct(F.lit(text).alias("token"), F.lit(0.0).alias("logprob"), m.alias("top"))
    tokens = F.array(token("FAITHFULNESS:", none), token(" PASS", top), token("\n", none), token("RELEVANCE:", none), token(" FAIL", top))
    said = s.withColumn("tokens", F.when(F.length("id") % 3 == 0, tokens)).withColumn("raw", F.concat(F.lit("FAITHFULNESS: "), F.when(F.col("faithfulness") == 1, "PASS").otherwise("FAIL")))
    read = said.withColumn("v", judging.token_verdicts(F.col("tokens")))
    value, how = judging.with_fallback(F.col("v.p_faith"), F.col("raw"), "FAITHFULNESS")
    return read.select("id", F.round(value, 6).alias("p_faith"), how.alias("how"))


@query("j06_near_pairs")
def j06(spark, sf_dir):
    first = groups.text_classes(case_keys(spark, sf_dir), F.col("query"))
    distinct = first.where(F.col("id") == F.col("class")).select("id", F.col("key").alias("text"))
    return r9(groups.near_pairs(distinct, 0.9), "similarity")


@query("k01_groups")
def k01(spark, sf_dir):
    return groups.build_groups(materialise(case_keys(spark, sf_dir)), F.col("query"), F.col("chunk"))


@query("k06_folds")
def k06(spark, sf_dir):
    c = guards.with_reliable(materialise(case_keys(spark, sf_dir)))
    g = groups.build_groups(c, F.col("query"), F.col("chunk"))
    return groups.assign_folds(c, g, "reliable", N_FOLDS, N_REPEATS)


@query("k07_fold_check")
def k07(spark, sf_dir):
    c, query, chunk = guards.with_reliable(materialise(case_keys(spark, sf_dir))), F.col("query"), F.col("chunk")
    links = groups.near_links(c, query)
    g = groups.build_groups(c, query, chunk, links=links)
    return groups.check_folds(c, materialise(groups.assign_folds(c, g, "reliable", N_FOLDS, N_REPEATS)), g, "reliable", N_FOLDS, query=query, chunk=chunk, links=links)


SURFACE = ("len_answer", "len_ctx", "len_query", "n_chunks", "overlap_ans_ctx_1", "overlap_ans_ctx_2", "overlap_ans_q_1", "digit_match_ratio", "url_or_nav_ratio")


@query("m01_oof_head")
def m01(spark, sf_dir):
    c = guards.with_reliable(cases(spark, sf_dir))
    x = features.surface(c).join(c.select("id", "reliable"), "id")
    return learned.oof_logistic(x, folds(spark, sf_dir), SURFACE, "reliable")


@query("m01_scores_auc")
def m03(spark, sf_dir):
    """AUC of the plain M01 head on a run's scores, out of fold; not the stack of M03."""
    s = guards.with_reliable(scores(spark, sf_dir))
    p = learned.oof_logistic(s, folds(spark, sf_dir), ("p_faith", "p_rel"), "reliable")
    return metrics.roc_auc(p.join(s.select("id", "reliable"), "id"), "p", "reliable")


@query("a01_b01_jsonl", with_(CASES) + "select id, sha256(question) as question, faithfulness::bigint as faithfulness, relevance::bigint as relevance from cases")
def a01(spark, sf_dir):
    path = f"{checkpoint_folder(spark)}/cases-{uuid.uuid4().hex}"
    writers.jsonl(marked_cases(spark, sf_dir), path)
    return readers.cases(spark, path).select("id", F.sha2("question", 256).alias("question"), "faithfulness", "relevance")


@query("a06_a07_scores", with_(CASES, A) + "select id, case when length(id) % 2 = 0 then 'm3' else 'legacy' end as prefix, round(p_faith, 9) as p_faith from scores")
def a06(spark, sf_dir):
    path = f"{checkpoint_folder(spark)}/scores-{uuid.uuid4().hex}"
    s = scores(spark, sf_dir)
    even = F.length("id") % 2 == 0
    keyed = F.create_map(F.lit("m3.p_faith"), "p_faith", F.lit("m3.p_rel"), "p_rel")
    writers.jsonl(s.select("id", F.when(even, keyed).alias("scores"), F.when(~even, F.col("p_faith")).alias("p_faith"), F.when(~even, F.col("p_rel")).alias("p_rel")), path)
    back = readers.score_source(spark, path)
    prefix = F.substring_index(F.get(F.map_keys("scores"), F.lit(0)), ".", 1)
    return back.select("id", prefix.alias("prefix"), F.round(F.try_element_at("scores", F.concat(prefix, F.lit(".p_faith"))), 9).alias("p_faith"))


@query("a10_b05_folds_file", with_(CASES, FOLDS) + "select id, repeat::bigint as repeat, fold::bigint as fold from folds")
def a10(spark, sf_dir):
    path = f"{checkpoint_folder(spark)}/folds-{uuid.uuid4().hex}"
    writers.jsonl(writers.folds_file(folds(spark, sf_dir), corpus_sha256="0" * 64, n_folds=5, seed=42).coalesce(1), path)
    return readers.folds(spark, path)


@query("b09_migration", with_(CASES, A) + "select id, round(p_faith, 9) as p_faith, round(p_rel, 9) as p_rel, true as partial from scores")
def b09(spark, sf_dir):
    m = writers.migrated(scores(spark, sf_dir).withColumn("scores", F.lit(None).cast("map<string,double>")), "m3", 10**9)
    again = writers.migrated(m.withColumn("p_faith", F.lit(0.0)).withColumn("p_rel", F.lit(0.0)), "m3", 10**9)
    return again.select("id", F.round(F.col("scores")["m3.p_faith"], 9).alias("p_faith"), F.round(F.col("scores")["m3.p_rel"], 9).alias("p_rel"), "partial")


@query("v01_v03_incremental", with_(CASES, A) + "select id, round(p_faith, 9) as score from scores")
def v01(spark, sf_dir):
    s = scores(spark, sf_dir).select("id", F.round("p_faith", 9).alias("score"))
    done = s.where(F.length("id") % 2 == 0)
    return incremental.score_new(scores(spark, sf_dir).select("id", "p_faith"), done, lambda df: df.select("id", F.round("p_faith", 9).alias("score")))


@query("v04_k20_last_epochs", """with log as (select doc_id % 3 as repeat, doc_id % 5 as fold, n_chars as epoch, n_chars % 2 = 0 as is_degenerate from documents where n_chars is not null)
  select repeat, fold, max(epoch) as epoch, bool_and(is_degenerate) filter (where epoch = m) as is_degenerate from (select *, max(epoch) over (partition by repeat, fold) as m from log) group by 1, 2""")  # fmt: skip
def v04(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars is not null")
    return incremental.last_epochs(d.select((F.col("doc_id") % 3).alias("repeat"), (F.col("doc_id") % 5).alias("fold"), F.col("n_chars").alias("epoch"), (F.col("n_chars") % 2 == 0).alias("is_degenerate")))
