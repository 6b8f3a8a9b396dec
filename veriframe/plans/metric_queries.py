"""Guards, joins, metrics, thresholds, folds and samples over cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import converters, features, guards, inference, metrics, sampling, score_expr, thresholds
from ..operators.groups import fold_stats, leak_rate
from .registry import query
from .text_queries import RULES
from .views import CASES, FOLDS, MARKED, cases, folds, marked_cases, scores, scores_sql, table, unit_sql, with_

A, B = scores_sql("a", 0.25, "scores"), scores_sql("b", 0.1, "other")


def f1(tn: str = "tn", fp: str = "fp", fn: str = "fn", tp: str = "tp") -> str:
    half = lambda a: f"(case when 2*{a}+{fp}+{fn} = 0 then 0.0::double else 2.0::double*{a}/(2*{a}+{fp}+{fn}) end)"
    return f"(({half(tn)} + {half(tp)}) / 2)"


def counts(y: str, p: str) -> str:
    return ", ".join(f"count(*) filter (where {y} = {a} and {p} = {b}) as {n}" for a, b, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")))


def r9(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else c for c in df.columns])


def score_map(s):
    return s.withColumn("scores", F.create_map(F.lit("m3.p_faith"), "p_faith", F.lit("m3.p_rel"), "p_rel"))


RELIABLE = "(case when faithfulness = 1 and relevance = 1 then 1 else 0 end)"
JUDGED = f"judged as (select id, {RELIABLE} as y, p_faith * p_rel as s, case when p_faith >= 0.5::double then 1 else 0 end as f, case when p_rel >= 0.5::double then 1 else 0 end as r from scores)"


def judged(spark, sf_dir, run="a", lean=0.25):
    s = guards.with_reliable(scores(spark, sf_dir, run, lean), name="y")
    return s.select("id", "y", (F.col("p_faith") * F.col("p_rel")).alias("s"), (F.col("p_faith") >= 0.5).cast("int").alias("f"), (F.col("p_rel") >= 0.5).cast("int").alias("r"), "p_faith", "p_rel", "faithfulness", "relevance")


@query("a40_violations", "select cast(doc_id as varchar) as id, 'marker' as reason from documents where source not in ('none', 'unknown') union all select cast(doc_id as varchar), 'relevance' from documents where n_chars % 3 = 2")
def a40(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return guards.case_violations(d.select(F.col("doc_id").cast("string").alias("id"), F.lit(1).alias("faithfulness"), (F.col("n_chars") % 3).alias("relevance"), F.col("source").alias("marker")))


@query("a41_reliable", with_(CASES) + f"select id, {RELIABLE}::bigint as reliable from cases")
def a41(spark, sf_dir):
    return guards.with_reliable(cases(spark, sf_dir)).select("id", "reliable")


@query("a42_duplicates", "select lang as id, count(*) as n from documents group by lang having count(*) > 1")
def a42(spark, sf_dir):
    return guards.duplicates(table(spark, sf_dir, "documents").select(F.col("lang").alias("id")))


@query("a42_missing", "select distinct cast(doc_id as varchar) as id from documents where doc_id not in (select doc_id from labels)")
def a42b(spark, sf_dir):
    wanted, given = (table(spark, sf_dir, t).select(F.col("doc_id").cast("string").alias("id")) for t in ("documents", "labels"))
    return guards.missing(wanted, given).distinct()


@query("a43_a44_contract", with_(CASES) + "select count(*) as n, count(distinct id) as n_ids, 0::bigint as n_lacking, 0::bigint as n_not_finite, 0::bigint as n_bad_keys from cases")
def a44(spark, sf_dir):
    return guards.contract(score_map(scores(spark, sf_dir)), ["m3.p_faith", "m3.p_rel"])


@query("a50_score_expression", with_(CASES, A) + "select id, round(-(p_faith + 2) * p_rel / (1 + p_faith), 9) as value from scores")
def a50(spark, sf_dir):
    e = score_expr.compile_expression("-(m3.p_faith + 2) * m3.p_rel / (1 + m3.p_faith)")
    return score_map(scores(spark, sf_dir)).select("id", F.round(e, 9).alias("value"))


@query("a51_default_score", with_(CASES, A) + "select id, round(p_faith * p_rel, 9) as value, round(p_faith, 9) as faith from scores")
def a51(spark, sf_dir):
    m = score_map(scores(spark, sf_dir))
    return m.select("id", F.round(score_expr.default_score(F.col("scores")), 9).alias("value"), F.round(score_expr.default_score(F.col("scores"), "p_faith"), 9).alias("faith"))


@query("a52_a53_binarise", with_(CASES, A) + "select id, case when p_faith >= 0.4::double then 1 else 0 end::bigint as f, case when p_rel >= 0.6::double then 1 else 0 end::bigint as r from scores")
def a53(spark, sf_dir):
    ok = scores(spark, sf_dir).withColumn("p_faith", guards.unit_interval(F.col("p_faith")))
    return ok.select("id", (F.col("p_faith") >= 0.4).cast("int").alias("f"), (F.col("p_rel") >= 0.6).cast("int").alias("r"))


@query("a58_correctness", with_(CASES, A, JUDGED) + "select j.id, case when length(j.id) % 2 = 0 then j.f = c.faithfulness end as faith_right, j.r = c.relevance as rel_right from judged j join cases c using (id)")
def a58(spark, sf_dir):
    j = judged(spark, sf_dir)
    return j.select("id", F.when(F.length("id") % 2 == 0, F.col("f") == F.col("faithfulness")).alias("faith_right"), (F.col("r") == F.col("relevance")).alias("rel_right"))


@query("a60_coverage", with_(CASES, FOLDS) + "select (select count(*) from cases) as corpus_n, count(distinct id) as oof_n, (select count(*) from cases) - count(distinct id) as excluded_n from folds")
def a60(spark, sf_dir):
    placed = folds(spark, sf_dir).select("id").distinct().withColumn("in", F.lit(1))
    return cases(spark, sf_dir).select("id").join(placed, "id", "left").agg(F.count(F.lit(1)).alias("corpus_n"), F.count("in").alias("oof_n"), F.count_if(F.col("in").isNull()).alias("excluded_n"))


def present(a: str) -> str:
    return f"""(case when (case when tn_{a}+fp_{a}+fn_{a} > 0 then 1 else 0 end) + (case when tp_{a}+fp_{a}+fn_{a} > 0 then 1 else 0 end) = 0 then 0.0::double else
      ((case when tn_{a}+fp_{a}+fn_{a} > 0 then 2.0::double*tn_{a}/(2*tn_{a}+fp_{a}+fn_{a}) else 0 end) + (case when tp_{a}+fp_{a}+fn_{a} > 0 then 2.0::double*tp_{a}/(2*tp_{a}+fp_{a}+fn_{a}) else 0 end))
      / ((case when tn_{a}+fp_{a}+fn_{a} > 0 then 1 else 0 end) + (case when tp_{a}+fp_{a}+fn_{a} > 0 then 1 else 0 end)) end)"""


EVALUATION = with_(CASES, RULES) + f"""select total, 0::bigint as invalid, 0.0::double as invalid_rate, {", ".join(f"round({present(a)}, 9) as macro_f1_{n}" for a, n in (("f", "faithfulness"), ("r", "relevance"), ("b", "reliable")))} from (
  select count(*) as total, {", ".join(f"count(*) filter (where {y} = {i} and {p} = {j}) as {n}_{a}" for a, y, p in (("f", "faithfulness", "faithfulness_pred"), ("r", "relevance", "relevance_pred"), ("b", "faithfulness * relevance", "faithfulness_pred * relevance_pred")) for i, j, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")))} from rules)"""  # fmt: skip


@query("g05_rule_evaluation", EVALUATION)
def g05(spark, sf_dir):
    c = cases(spark, sf_dir)
    e = metrics.evaluation(c, features.rules(c))
    return r9(e, "invalid_rate", "macro_f1_faithfulness", "macro_f1_relevance", "macro_f1_reliable")


@query("g01_g02_g03_confusion", with_(CASES, A, JUDGED) + f"""select tn, fp, fn, tp, round({f1()}, 9) as macro_f1, round(case when tp+fn = 0 then 0.0::double else tp::double/(tp+fn) end, 9) as recall,
  round(case when tn+fp = 0 then 0.0::double else tn::double/(tn+fp) end, 9) as specificity from (select {counts('y', 'f')} from judged)""")  # fmt: skip
def g01(spark, sf_dir):
    c = judged(spark, sf_dir).agg(*metrics.confusion("y", "f"))
    return c.select("tn", "fp", "fn", "tp", F.round(metrics.macro_f1(), 9).alias("macro_f1"), F.round(metrics.recall(), 9).alias("recall"), F.round(metrics.specificity(), 9).alias("specificity"))


@query("g04_marker_f1", with_(MARKED, f", pm as (select marker as g, case when {unit_sql("'p:' || id")} < 0.6 then marker when {unit_sql("'p:' || id")} < 0.9 then 'contradiction' else 'unknown' end as p from marked)".lstrip(", ")) + """
  select marker, sum(s)::bigint as support, sum(q)::bigint as predicted, sum(h)::bigint as hits, round(case when sum(s) + sum(q) = 0 then 0.0::double else 2.0::double * sum(h) / (sum(s) + sum(q)) end, 9) as f1 from (
  select g as marker, 1 as s, 0 as q, case when g = p then 1 else 0 end as h from pm union all select p, 0, 1, 0 from pm) group by marker""")  # fmt: skip
def g04(spark, sf_dir):
    u = numeric.hash_unit(F.concat(F.lit("p:"), "id"))
    m = marked_cases(spark, sf_dir).withColumn("marker_pred", F.when(u < 0.6, F.col("marker")).when(u < 0.9, F.lit("contradiction")))
    return r9(metrics.marker_f1(m), "f1")


@query("g06_operational", with_(CASES, A, JUDGED) + f""", risk as (select 1 - y as bad, 1 - s as risk, case when s < 0.3::double then 1 else 0 end as flag from judged),
  g as (select risk, count(*) as n, sum(bad)::bigint as pos from risk group by risk),
  cur as (select *, sum(n) over (order by risk desc)::double as flagged, sum(pos) over (order by risk desc)::double as hits, sum(pos) over ()::double as allpos, sum(n - pos) over (order by risk) - (n - pos) as below from g)
  select c.n, round(a.auc, 9) as roc_auc, round(a.ap, 9) as pr_auc, round(c.base_rate, 9) as base_rate, round(case when c.base_rate = 0 then 0.0::double else a.ap / c.base_rate end, 9) as lift,
    round(recall_at_50, 9) as recall_at_50, round(recall_at_60, 9) as recall_at_60, round(recall_at_70, 9) as recall_at_70, round((fp + tp)::double / c.n, 9) as flagged_share, tn, fp, fn, tp
  from (select count(*) as n, avg(bad::double) as base_rate, {counts('bad', 'flag')} from risk) c,
  (select sum(pos / allpos * (hits / flagged)) as ap, sum(pos * (below + (n - pos) / 2.0::double))::double / (sum(pos) * sum(n - pos)) as auc,
    coalesce(max(hits / allpos) filter (where hits / flagged >= 0.5::double), 0.0) as recall_at_50, coalesce(max(hits / allpos) filter (where hits / flagged >= 0.6::double), 0.0) as recall_at_60,
    coalesce(max(hits / allpos) filter (where hits / flagged >= 0.7::double), 0.0) as recall_at_70 from cur) a""")  # fmt: skip
def g06(spark, sf_dir):
    o = metrics.operational(judged(spark, sf_dir), "y", "s", 0.3)
    return r9(o, *[c for c in o.columns if c not in ("n", "tn", "fp", "fn", "tp")])


@query("g07_degeneracy", with_(CASES, A, JUDGED) + "select round(max(share), 9) as const_share, round(abs(-sum(share * log2(share))), 9) as output_entropy, max(share) > 0.98 as is_degenerate from (select count(*)::double / sum(count(*)) over () as share from judged group by f, r)")
def g07(spark, sf_dir):
    return r9(metrics.degeneracy(judged(spark, sf_dir), "f", "r"), "const_share", "output_entropy")


@query("g08_class_balance", with_(CASES) + "select axis, count(*) filter (where label = 1) as n1, count(*) filter (where label = 0) as n0 from (select 'faithfulness' as axis, faithfulness as label from cases union all select 'relevance', relevance from cases) group by axis")
def g08(spark, sf_dir):
    long = cases(spark, sf_dir).select("id", "faithfulness", "relevance").unpivot("id", ["faithfulness", "relevance"], "axis", "label")
    return long.groupBy("axis").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))


@query("g09_fold_stats", with_(CASES, FOLDS) + f"select g.repeat, g.fold, count(c.id) as size, round(coalesce(avg({RELIABLE}::double) filter (where c.id is not null), 0.0), 9) as pos_rate from (select r as repeat, k as fold from range(3) a(r), range(5) b(k)) g left join folds f on f.repeat = g.repeat and f.fold = g.fold left join cases c on c.id = f.id group by 1, 2")
def g09(spark, sf_dir):
    return r9(fold_stats(guards.with_reliable(cases(spark, sf_dir)), folds(spark, sf_dir), "reliable", 5, 3), "pos_rate")


@query("g17_marker_recall", with_(MARKED, A, JUDGED) + "select marker, count(*) as n, count(*) filter (where f * r = 0) as caught from judged join marked using (id) where y = 0 group by marker")
def g17(spark, sf_dir):
    j = judged(spark, sf_dir).join(marked_cases(spark, sf_dir).select("id", "marker"), "id").where("y = 0")
    return j.groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f") * F.col("r") == 0).alias("caught"))


@query("g18_lengths", "select source, count(*) as n, round(median(n_chars::double), 9) as p50, round(quantile_cont(n_chars::double, 0.95), 6) as p95, round(avg(case when n_chars > 5000 then 1.0 else 0.0 end::double), 9) as cut_share, round(sum(greatest(n_chars - 5000, 0))::double / sum(n_chars), 9) as lost from documents group by source")
def g18(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("x", F.col("n_chars").cast("double"))
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.percentile("x", 0.5), 9).alias("p50"), F.round(F.percentile("x", 0.95), 6).alias("p95"), F.round(F.avg((F.col("n_chars") > 5000).cast("double")), 9).alias("cut_share"),
        F.round(F.sum(F.greatest(F.col("n_chars") - 5000, F.lit(0))) / F.sum("n_chars"), 9).alias("lost"),
    )


@query("g19_kappa", with_(CASES, A, JUDGED) + f", c as (select {counts('f', 'r')}, count(*)::double as n from judged)" + " select tn, fp, fn, tp, round(((tn+tp)/n - ((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))/(n*n)) / (1 - ((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))/(n*n)), 9) as kappa from c")
def g19(spark, sf_dir):
    return judged(spark, sf_dir).agg(*metrics.confusion("f", "r")).select("tn", "fp", "fn", "tp", F.round(metrics.kappa(), 9).alias("kappa"))


@query("g21_g22_g23_weights", with_(CASES) + f"select {RELIABLE}::bigint as y, count(*) as n, round((select count(*) from cases)::double / (2 * count(*)), 9) as weight from cases group by 1")
def g22(spark, sf_dir):
    c = guards.with_reliable(cases(spark, sf_dir), name="y").groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return c.select("y", "n", F.round(F.sum("n").over(Window.partitionBy()) / (2 * F.col("n")), 9).alias("weight"))


@query("f02_roc_auc", with_(CASES, A, JUDGED) + """, k as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as ar from judged)
  select count(*) as n, sum(y)::bigint as n_pos, round((sum(ar) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * sum(1 - y)), 9) as auc from k""")  # fmt: skip
def f02(spark, sf_dir):
    return r9(metrics.roc_auc(judged(spark, sf_dir), "s", "y"), "auc")


@query("f03_precision_recall", with_(CASES, A, JUDGED) + """, g as (select s, count(*) as n, sum(y) as pos from judged group by s)
  select round(s, 9) as s, flagged::bigint as flagged, hits::bigint as hits, round(hits::double / flagged, 9) as precision, round(hits::double / allpos, 9) as recall from (
  select s, sum(n) over (order by s desc) as flagged, sum(pos) over (order by s desc) as hits, sum(pos) over () as allpos from g)""")  # fmt: skip
def f03(spark, sf_dir):
    return r9(metrics.precision_recall(judged(spark, sf_dir), "s", "y").drop("step"), "s", "precision", "recall")


@query("f01_last_row_wins", "select lang as id, min(doc_id) as row_number, arg_max(source, doc_id) as source, count(distinct source) > 1 as conflict from documents group by lang")
def f01(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("id"), F.col("doc_id").alias("row_number"), "source")
    return converters.last_by_id(d, "id", "row_number", ["source"])


@query("f06_first_rows", "select doc_id, source from documents order by doc_id limit 25")
def f06(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(25)


@query("f07_hash_sample", "select doc_id from documents order by md5('7:' || doc_id), doc_id limit 50")
def f07(spark, sf_dir):
    return sampling.first_by_hash(table(spark, sf_dir, "documents").select("doc_id"), 50, "7", "doc_id")


@query("j01_gold_predictions", with_(CASES, RULES) + "select id, faithfulness::bigint as faithfulness, faithfulness_pred::bigint as faithfulness_pred, relevance::bigint as relevance, relevance_pred::bigint as relevance_pred from rules")
def j01(spark, sf_dir):
    c = cases(spark, sf_dir)
    return c.select("id", "faithfulness", "relevance").join(features.rules(c).select("id", "faithfulness_pred", "relevance_pred"), "id")


@query("j02_j03_feature_matrix", with_(CASES, A, B) + f"select a.id, round(a.p_faith, 9) as a_faith, round(b.p_faith, 9) as b_faith from scores a join other b using (id) where {unit_sql("'src:' || a.id")} < 0.7")
def j02(spark, sf_dir):
    a, b = scores(spark, sf_dir), scores(spark, sf_dir, "b", 0.1).where(numeric.hash_unit(F.concat(F.lit("src:"), "id")) < 0.7)
    return a.join(b.select("id", F.col("p_faith").alias("b_faith")), "id").select("id", F.round("p_faith", 9).alias("a_faith"), F.round("b_faith", 9).alias("b_faith"))


@query("j05_unplaced", with_(CASES, FOLDS) + "select id from cases where id not in (select id from folds)")
def j05(spark, sf_dir):
    return cases(spark, sf_dir).select("id").join(folds(spark, sf_dir), "id", "left_anti")


@query("j11_leak_rate", with_(CASES, FOLDS) + """, p as (select repeat, fold, answer from folds join cases using (id)), k as (select repeat, answer, count(distinct fold) > 1 as split, count(*) as n from p where answer is not null group by 1, 2)
  select repeat, sum(n)::bigint as n, coalesce(sum(n) filter (where split), 0)::bigint as leaked, round(coalesce(sum(n) filter (where split), 0)::double / sum(n), 9) as rate from k group by repeat""")  # fmt: skip
def j11(spark, sf_dir):
    return r9(leak_rate(cases(spark, sf_dir), "answer", folds(spark, sf_dir)), "rate")


GRID = "grid as (select i, case when i = 100 then 1.0::double else i * 0.01::double end as t from range(101) g(i))"
SWEPT = f"swept as (select i, t, tn, fp, fn, tp, {f1()} as macro_f1 from (select i, t, {counts('y', '(case when s >= t then 1 else 0 end)')} from judged, grid group by i, t))"


@query("k02_sweep", with_(CASES, A, JUDGED, GRID, SWEPT) + "select i as bin, t as threshold, tn, fp, fn, tp, round(macro_f1, 9) as macro_f1 from swept")
def k02(spark, sf_dir):
    return r9(thresholds.sweep(thresholds.histogram(judged(spark, sf_dir), "y", "s")), "macro_f1")


@query("k03_threshold", with_(CASES, A, JUDGED, GRID, SWEPT) + "select t as threshold, round(macro_f1, 9) as macro_f1 from swept order by macro_f1 desc, i limit 1")
def k03(spark, sf_dir):
    return r9(thresholds.fit(judged(spark, sf_dir), "y", "s"), "macro_f1")


@query("k04_threshold_pair", with_(CASES, A, GRID, f"""pairs as (select ti, tj, i, j, {counts('y', '(case when p_faith >= ti and p_rel >= tj then 1 else 0 end)')} from
  (select *, {RELIABLE} as y from scores), (select a.t as ti, b.t as tj, a.i as i, b.i as j from grid a, grid b) group by ti, tj, i, j)""") + f"select ti as t_first, tj as t_second, round({f1()}, 9) as macro_f1 from pairs order by {f1()} desc, i, j limit 1")  # fmt: skip
def k04(spark, sf_dir):
    return r9(thresholds.fit_pair(judged(spark, sf_dir), "y", "p_faith", "p_rel"), "macro_f1")


FITTED = f"""fitted as (select repeat, fold, arg_max(t, (macro_f1, -i)) as threshold from (select repeat, fold, i, t, {f1()} as macro_f1 from (
  select k.repeat, k.fold, i, t, {counts('y', '(case when s >= t then 1 else 0 end)')} from (select distinct repeat, fold from folds) k join folds f on f.repeat = k.repeat and f.fold <> k.fold join judged using (id), grid group by 1, 2, 3, 4)) group by 1, 2)"""
VOTES = "votes as (select id, y, avg(s) as oof_score, avg(case when s >= threshold then 1.0::double else 0.0::double end) as vote from judged join folds using (id) join fitted using (repeat, fold) group by 1, 2)"


@query("k08_cross_validation", with_(CASES, A, JUDGED, FOLDS, GRID, FITTED, VOTES) + "select id, y::bigint as y, round(oof_score, 9) as oof_score, round(vote, 9) as vote, case when vote >= 0.5 then 1 else 0 end::bigint as pred from votes")
def k08(spark, sf_dir):
    return r9(thresholds.cross_validate(judged(spark, sf_dir).select("id", "y", "s"), folds(spark, sf_dir), "y", "s"), "oof_score", "vote")


@query("k08_report", with_(CASES, A, JUDGED, FOLDS, GRID, FITTED, VOTES) + f"select n, (select count(*) from judged) - n as n_excluded, tn, fp, fn, tp, round({f1()}, 9) as macro_f1 from (select count(*) as n, {counts('y', '(case when vote >= 0.5 then 1 else 0 end)')} from votes)")
def k16(spark, sf_dir):
    return r9(thresholds.cross_validated_report(judged(spark, sf_dir).select("id", "y", "s"), folds(spark, sf_dir), "y", "s"), "macro_f1")


@query("k14_mcnemar", with_(CASES, A, B) + f"""select b, c, round(case when b + c = 0 then 1.0::double else least(1.0::double, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::double))))) end, 7) as p from (
  select count(*) filter (where x = y and z <> y) as b, count(*) filter (where x <> y and z = y) as c from (select {RELIABLE} as y, case when a.p_faith * a.p_rel >= 0.3::double then 1 else 0 end as x, case when b.p_faith * b.p_rel >= 0.3::double then 1 else 0 end as z from scores a join (select id, p_faith, p_rel from other) b using (id)))""".replace("{RELIABLE}", RELIABLE))  # fmt: skip
def k14(spark, sf_dir):
    b = judged(spark, sf_dir, "b", 0.1).select("id", (F.col("s") >= 0.3).cast("int").alias("z"))
    both = judged(spark, sf_dir).withColumn("x", (F.col("s") >= 0.3).cast("int")).join(b, "id")
    return inference.mcnemar(both, "y", "x", "z").select("b", "c", F.round("p", 7).alias("p"))


@query("k10_bootstrap")
def k10(spark, sf_dir):
    return inference.bootstrap_macro_f1(judged(spark, sf_dir).withColumn("p", (F.col("s") >= 0.3).cast("int")), "y", "p")


@query("k11_paired_bootstrap")
def k11(spark, sf_dir):
    b = judged(spark, sf_dir, "b", 0.1).select("id", (F.col("s") >= 0.3).cast("int").alias("z"))
    return inference.paired_bootstrap(judged(spark, sf_dir).withColumn("x", (F.col("s") >= 0.3).cast("int")).join(b, "id"), "y", "x", "z")


@query("k12_stratified_bootstrap")
def k12(spark, sf_dir):
    b = judged(spark, sf_dir, "b", 0.1).select("id", (F.col("s") >= 0.3).cast("int").alias("z"))
    return inference.paired_bootstrap(judged(spark, sf_dir).withColumn("x", (F.col("s") >= 0.3).cast("int")).join(b, "id"), "y", "x", "z", stratified=True)


TRIALS = 500


@query("k15_null_calibration", with_(CASES, FOLDS, GRID) + f""", noisy as (select tr, id, {RELIABLE} as y, {unit_sql("tr || ':' || id")} as s from cases, range({TRIALS}) n(tr)),
  fit as (select tr, repeat, fold, arg_max(t, (macro_f1, -i)) as threshold from (select tr, repeat, fold, i, t, {f1()} as macro_f1 from (
    select tr, k.repeat, k.fold, i, t, {counts('y', '(case when s >= t then 1 else 0 end)')} from (select distinct repeat, fold from folds) k join folds f on f.repeat = k.repeat and f.fold <> k.fold join noisy using (id), grid group by 1, 2, 3, 4, 5)) group by 1, 2, 3),
  each as (select tr, repeat, {f1()} as f1 from (select tr, repeat, {counts('y', '(case when s >= threshold then 1 else 0 end)')} from noisy join folds using (id) join fit using (tr, repeat, fold) group by 1, 2))
  select tr as trial, round(avg(f1), 9) as macro_f1 from each group by tr""")  # fmt: skip
def k15(spark, sf_dir):
    y = guards.with_reliable(cases(spark, sf_dir), name="y").select("id", "y")
    return r9(thresholds.null_distribution(y, folds(spark, sf_dir), "y", TRIALS), "macro_f1")


@query("k18_reconstruction", with_(CASES, A, JUDGED) + f"""select tn, fp, fn, tp from (select q.*, row_number() over (order by abs({f1()} - target), tp) as place from (
  select tp, n_pred - tp as fp, n_gold - tp as fn, n - n_gold - n_pred + tp as tn, target from (select n, n_gold, n_pred, target, unnest(range(greatest(0, n_gold + n_pred - n), least(n_gold, n_pred) + 1)) as tp from (
    select n, tp + fn as n_gold, tp + fp as n_pred, round({f1()}, 4) as target from (select count(*) as n, {counts('y', 'f')} from judged)))) q) where place = 1""")  # fmt: skip
def k18(spark, sf_dir):
    """The confusion of a run's decisions, from its margins and its macro-F1 of four digits."""
    c = judged(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *metrics.confusion("y", "f")).withColumn("f1", F.round(metrics.macro_f1(), 4)).first()
    return inference.reconstruct_confusion(spark, c["n"], c["tp"] + c["fn"], c["tp"] + c["fp"], c["f1"])


@query("k17_feature_auc", with_(CASES, A) + """, long as (select 'p_faith' as feature, p_faith as v, faithfulness as y from scores union all select 'p_rel', p_rel, faithfulness from scores),
  k as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0::double as ar from long)
  select feature, count(*) as n, sum(y)::bigint as n_pos, round((sum(ar) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * sum(1 - y)), 9) as auc from k group by feature""")  # fmt: skip
def k17(spark, sf_dir):
    long = scores(spark, sf_dir).select("id", F.col("faithfulness").alias("y"), "p_faith", "p_rel").unpivot(["id", "y"], ["p_faith", "p_rel"], "feature", "v")
    return r9(metrics.roc_auc(long, "v", "y", ["feature"]), "auc")


@query("k19_length_auc", with_(CASES) + f"""select count(*) as n, sum(y)::bigint as n_pos, round((sum(ar) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * sum(1 - y)), 9) as auc from (
  select y, rank() over (order by l) + (count(*) over (partition by l) - 1) / 2.0::double as ar from (select {RELIABLE} as y, length(answer) as l from cases))""")  # fmt: skip
def k19(spark, sf_dir):
    return r9(metrics.roc_auc(guards.with_reliable(cases(spark, sf_dir)).withColumn("l", F.length("answer")), "l", "reliable"), "auc")


@query("m02_majority", with_(CASES, FOLDS) + f"""select repeat, fold, round((sum(sum(y)) over (partition by repeat) - sum(y))::double / (sum(count(*)) over (partition by repeat) - count(*)), 9) as train_rate from (select repeat, fold, {RELIABLE} as y from folds join cases using (id)) group by repeat, fold""")
def m02(spark, sf_dir):
    own = guards.with_reliable(cases(spark, sf_dir)).select("id", "reliable").join(folds(spark, sf_dir), "id").groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("reliable").alias("p"))
    w = Window.partitionBy("repeat")
    return own.select("repeat", "fold", F.round((F.sum("p").over(w) - F.col("p")) / (F.sum("n").over(w) - F.col("n")), 9).alias("train_rate"))


RANKED = f"ranked as (select id, faithfulness, relevance, {RELIABLE} as y, row_number() over (partition by {{by}} order by {unit_sql("'42:' || id")}, id) as rank, count(*) over (partition by {{by}}) as size from cases)"


@query("s06_split", with_(CASES, RANKED.replace("{by}", RELIABLE)) + """select id, case when rank <= a then 'train' when rank <= a + b then 'val' else 'test' end as split from (
  select *, round_even(size * 0.8::double, 0) as a, round_even(size * 0.1::double, 0) as b from ranked)""")  # fmt: skip
def s06(spark, sf_dir):
    return sampling.split_80_10_10(guards.with_reliable(cases(spark, sf_dir), name="y").select("id", "y"), "y").select("id", "split")


@query("s04_balanced", with_(CASES, RANKED.replace("{by}", "faithfulness, relevance")) + "select id, k as replica from ranked, range(0, 60) t(k) where rank <= 60 and (k = 0 or size < 60) and rank + k * size <= 60")
def s04(spark, sf_dir):
    return sampling.balanced(cases(spark, sf_dir).select("id", "faithfulness", "relevance"), ["faithfulness", "relevance"], 60).select("id", "replica")


@query("s08_cyclic", with_(CASES, RANKED.replace("{by}", "faithfulness, relevance")) + "select id, k as replica from ranked, (select max(size) as most from ranked), range(0, 100000) t(k) where rank + k * size <= most")
def s08(spark, sf_dir):
    return sampling.cyclic_oversample(cases(spark, sf_dir).select("id", "faithfulness", "relevance"), ["faithfulness", "relevance"]).select("id", "replica")


@query("s03_oversample_negatives", with_(CASES, RANKED.replace("{by}", RELIABLE)) + "select id, k as replica from ranked, (select count(*) filter (where y = 1) as pos from ranked), range(0, 100000) t(k) where (y = 1 and k = 0) or (y = 0 and (k = 0 or rank + k * size <= pos))")
def s03(spark, sf_dir):
    return sampling.oversample_negatives(guards.with_reliable(cases(spark, sf_dir), name="y").select("id", "y"), "y").select("id", "replica")


@query("s05_subsample", with_(CASES, RANKED.replace("{by}", RELIABLE)) + """select id from ranked, (select least(50, count(*)) as take, count(*) as n, count(*) filter (where y = 1) as pos from ranked) q
  where rank <= case when y = 1 then greatest(floor(take * pos / n), take - (n - pos)) else take - greatest(floor(take * pos / n), take - (n - pos)) end""")  # fmt: skip
def s05(spark, sf_dir):
    return sampling.stratified_subsample(guards.with_reliable(cases(spark, sf_dir), name="y").select("id", "y"), 50, "y", "42").select("id")


@query("s01_s02_sets", "select 'union' as op, count(*) as n from (select doc_id from documents union all select doc_id from labels) union all select 'shared', count(*) from (select doc_id from documents intersect select doc_id from labels) union all select 'only documents', count(*) from (select doc_id from documents except select doc_id from labels)")
def s01(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    n = lambda op, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n("union", a.unionByName(b)).unionByName(n("shared", a.intersect(b))).unionByName(n("only documents", a.subtract(b)))
