"""Rules of comparison over cases, with faults put in so that a rule that finds none would show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.numeric import hash_unit
from ..operators import protocol, thresholds
from .metric_queries import A, B, FITTED, GRID, JUDGED, RELIABLE, counts, f1, judged, r9
from .registry import query
from .views import CASES, FOLDS, N_FOLDS, cases, folds, unit_sql, with_

#: Cases whose hash is below this get a second fold in repeat 1, and those above the other one a fold that doesn't exist.
TWICE, BEYOND = 0.1, 0.95


@query("k09_fold_isolation", with_(CASES, FOLDS, f"""broken as (select id, repeat, case when repeat = 0 then 3 when repeat = 2 and {unit_sql("'b:' || id")} > {BEYOND}::double then {N_FOLDS} else fold end as fold from folds
  union all select id, repeat, (fold + 1) % {N_FOLDS} from folds where repeat = 1 and {unit_sql("'b:' || id")} < {TWICE}::double)""") + f"""select repeat, id, 'several folds' as reason from broken group by 1, 2 having count(*) > 1
  union all select repeat, id, 'no such fold' from broken where fold is null or fold not between 0 and {N_FOLDS - 1}
  union all select repeat, null, 'fewer than two folds' from broken group by 1 having count(distinct fold) < 2""")  # fmt: skip
def k09(spark, sf_dir):
    f, u = folds(spark, sf_dir), hash_unit(F.concat(F.lit("b:"), "id"))
    fold = F.when(F.col("repeat") == 0, 3).when((F.col("repeat") == 2) & (u > BEYOND), N_FOLDS).otherwise(F.col("fold"))
    twice = f.where((F.col("repeat") == 1) & (u < TWICE)).withColumn("fold", (F.col("fold") + 1) % N_FOLDS)
    return protocol.fold_violations(f.withColumn("fold", fold).unionByName(twice), N_FOLDS)


@query("k09_train_optimality", with_(CASES, A, JUDGED, FOLDS, GRID, FITTED, f"""trained as (select repeat, fold, i, t, {f1()} as macro_f1 from (
  select k.repeat, k.fold, i, t, {counts('y', '(case when s >= t then 1 else 0 end)')} from (select distinct repeat, fold from folds) k join folds f on f.repeat = k.repeat and f.fold <> k.fold join judged using (id), grid group by 1, 2, 3, 4)),
most as (select repeat, fold, max(macro_f1) as most from trained group by 1, 2),
used as (select repeat, fold, case when fold = 1 then (select t from grid where i = 70) else threshold end as threshold from fitted where fold <> 2)""") + """select m.repeat, m.fold, u.threshold, round(t.macro_f1, 9) as macro_f1, round(m.most - t.macro_f1, 9) as gap
  from most m left join used u on u.repeat = m.repeat and u.fold = m.fold left join trained t on t.repeat = m.repeat and t.fold = m.fold and t.t = u.threshold""")  # fmt: skip
def k09_optimal(spark, sf_dir):
    df, f = judged(spark, sf_dir).select("id", "y", "s"), folds(spark, sf_dir)
    used = thresholds.fold_thresholds(df, f, "y", "s").where("fold <> 2")
    used = used.withColumn("threshold", F.when(F.col("fold") == 1, thresholds.threshold_of(F.lit(70))).otherwise(F.col("threshold")))
    return r9(protocol.threshold_gaps(df, f, used, "y", "s"), "macro_f1", "gap")


@query("j04_paired_runs", with_(CASES, A, B) + f"select a.id, {RELIABLE.replace('faithfulness', 'a.faithfulness').replace('relevance', 'a.relevance')}::bigint as y, round(a.p_faith * a.p_rel, 9) as s, round(b.p_faith * b.p_rel, 9) as other_s from scores a join other b using (id) where length(a.id) % 2 = 0")
def j04(spark, sf_dir):
    a, b = (judged(spark, sf_dir, run, lean).select("id", "y", "s") for run, lean in (("a", 0.25), ("b", 0.1)))
    both = protocol.paired(a.where(F.length("id") % 2 == 0), b)
    return r9(both.select("id", "y", "s", "other_s"), "s", "other_s")


@query("a57_same_corpus", with_(CASES, "n as (select count(*) as n, count(*) filter (where cast(id as bigint) % 97 = 0) as touched from cases)")
    + "select 'reordered' as copy, n, true as same from n union all select 'relabelled', n, touched = 0 from n union all select 'shorter', n - touched, touched = 0 from n union all select 'doubled', n + touched, touched = 0 from n")
def a57(spark, sf_dir):
    """Copies of the cases, some of them tampered with: which of them have the fingerprint of the cases."""
    c, some = cases(spark, sf_dir), F.col("id").cast("bigint") % 97 == 0
    copies = {
        "reordered": c.repartition(3), "relabelled": c.withColumn("relevance", F.when(some, 1 - F.col("relevance")).otherwise(F.col("relevance"))),
        "shorter": c.where(~some), "doubled": c.unionByName(c.where(some)),
    }
    want = protocol.fingerprint(c).first()
    each = [protocol.fingerprint(df).select(F.lit(name).alias("copy"), F.col("rows").alias("n"), ((F.col("rows") == want["rows"]) & (F.col("content") == F.lit(want["content"]))).alias("same")) for name, df in copies.items()]
    return reduce(lambda x, y: x.unionByName(y), each)


@query("a55_scores_only", with_(CASES, A, JUDGED) + "select id, 0::bigint as faithfulness_pred, 0::bigint as relevance_pred, round(p_faith, 9) as p_faith, round(p_rel / 2, 9) as p_rel, 2::bigint as n_scores from judged join scores using (id)")
def a55(spark, sf_dir):
    j = judged(spark, sf_dir).select("id", F.col("f").alias("faithfulness_pred"), F.col("r").alias("relevance_pred"), F.create_map(F.lit("m.p_faith"), "p_faith", F.lit("m.p_rel"), "p_rel").alias("scores"))
    out = protocol.scores_only(j, F.create_map(F.lit("m.p_rel"), F.col("scores")["m.p_rel"] / 2))
    out = out.select("id", "faithfulness_pred", "relevance_pred", F.col("scores")["m.p_faith"].alias("p_faith"), F.col("scores")["m.p_rel"].alias("p_rel"), F.size("scores").alias("n_scores"))
    return r9(out, "p_faith", "p_rel")


SAID = "list_filter([case when length(answer) % 3 = 0 then 'off_topic_answer' end, case when length(answer) % 2 = 0 then 'hallucination' else 'contradiction' end, case when length(question) % 2 = 0 then 'hallucination' else '' end], lambda m: m is not null and m <> '')"


SAID_REL = "list_filter([case when length(question) % 3 = 0 then 'context_mixing' end, case when length(answer) % 5 < 2 then 'off_topic_answer' else '' end, case when length(question) % 4 < 2 then 'context_mixing' end], lambda m: m is not null and m <> '')"


def top_of(said: str) -> str:
    return f"list_reverse_sort(list_transform(list_distinct({said}), lambda m: {{'n': len(list_filter({said}, lambda x: x = m)), 'place': -list_position({said}, m), 'm': m}}))[1].m"


@query("g24_pick_marker", with_(CASES, A, f"said as (select id, p_faith, p_rel, {SAID} as ms, {SAID_REL} as rs from scores)", f"tops as (select *, {top_of('ms')} as top, {top_of('rs')} as rel_top from said)")
    + "select id, case when p_faith < 0.5 and (p_rel >= 0.5 or p_faith <= p_rel) then coalesce(top, 'unknown') when p_rel < 0.5 then coalesce(rel_top, 'unknown') else 'none' end as marker from tops")
def g24(spark, sf_dir):
    from .views import scores

    a, q = F.length("answer"), F.length("question")
    said = F.array(F.when(a % 3 == 0, "off_topic_answer"), F.when(a % 2 == 0, "hallucination").otherwise("contradiction"), F.when(q % 2 == 0, "hallucination").otherwise(""))
    rel = F.array(F.when(q % 3 == 0, "context_mixing"), F.when(a % 5 < 2, "off_topic_answer").otherwise(""), F.when(q % 4 < 2, "context_mixing"))
    return scores(spark, sf_dir).select("id", protocol.pick_marker(F.col("p_faith"), F.col("p_rel"), said, rel).alias("marker"))


@query("f12_last_rows", "select doc_id, source from documents order by doc_id desc limit 25")
def f12(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return protocol.last_rows(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id")
