"""The stack, whole reports and noise by counts, over cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, metrics, report, stacking, thresholds
from ..sources import writers
from .metric_queries import A, B, FITTED, GRID, RELIABLE, TRIALS, VOTES, counts, f1, judged, r9
from .registry import query
from .views import CASES, FOLDS, cases, folds, scores, with_

STACK = ("p_faith", "p_rel", "len_answer", "len_question")


def stack_features(spark, sf_dir):
    s = guards.with_reliable(scores(spark, sf_dir))
    return s.select("id", "reliable", "p_faith", "p_rel", F.length("answer").cast("double").alias("len_answer"), F.length("question").cast("double").alias("len_question"))


@query("m03_stack")
def m03(spark, sf_dir):
    """(id, p): two scores and two lengths, calibrated, out of fold."""
    return r9(stacking.stacked(stack_features(spark, sf_dir), folds(spark, sf_dir), STACK, "reliable"), "p")


@query("m03_stack_auc")
def m03_auc(spark, sf_dir):
    s = stack_features(spark, sf_dir)
    return r9(metrics.roc_auc(stacking.stacked(s, folds(spark, sf_dir), STACK, "reliable").join(s.select("id", "reliable"), "id"), "p", "reliable"), "auc")


@query("k15_null_by_counts")
def k15(spark, sf_dir):
    """Noise drawn by counts; k15_null_calibration draws it case by case, from hashes that SQL has too."""
    y = guards.with_reliable(cases(spark, sf_dir), name="y").select("id", "y")
    return r9(thresholds.null_distribution_drawn(y, folds(spark, sf_dir), "y", TRIALS), "macro_f1")


AXES = {"reliable": ("y", "s"), "faithfulness": ("faithfulness", "p_faith"), "relevance": ("relevance", "p_rel")}


def whole_report(spark, sf_dir):
    b = judged(spark, sf_dir, "b", 0.1).select("id", "y", (F.col("s") >= 0.3).cast("int").alias("pred"))
    return report.assemble(judged(spark, sf_dir), folds(spark, sf_dir), AXES, others={"b": b})


@query("k16_report")
def k16(spark, sf_dir):
    return r9(whole_report(spark, sf_dir), "value")


@query("b06_report_json")
def b06(spark, sf_dir):
    return writers.report_json(whole_report(spark, sf_dir), method="m3", variant="a", protocol={"trials": TRIALS})


def of_axis(axis: str, y: str, s: str) -> str:
    """CTEs judged_, fitted_ and votes_ of an axis."""
    named = lambda text: text.replace("fitted as", f"fitted_{axis} as").replace("votes as", f"votes_{axis} as").replace("join fitted ", f"join fitted_{axis} ").replace("judged", f"judged_{axis}")
    return ",\n".join([f"judged_{axis} as (select id, {y} as y, {s} as s from scores)", named(FITTED), named(VOTES)])


def row(section: str, name: str, value: str) -> str:
    return f"select '{section}' as section, '{name}' as name, ({value})::double as value"


VOTED = "(case when vote >= 0.5::double then 1 else 0 end)"
POINTS = [row("primary" if axis == "reliable" else f"axis.{axis}", "value", f"select {f1()} from (select {counts('y', VOTED)} from votes_{axis})") for axis in AXES]
POINTS += [row("operational", name, f"select {value} from at_work") for name, value in {
    "n": "n", "roc_auc": "auc", "pr_auc": "ap", "base_rate": "base_rate", "lift": "case when base_rate = 0 then 0.0::double else ap / base_rate end", "recall_at_50": "recall_at_50", "recall_at_60": "recall_at_60",
    "recall_at_70": "recall_at_70", "flagged_share": "(fp + tp)::double / n", "tn": "tn", "fp": "fp", "fn": "fn", "tp": "tp"}.items()]
PAIRED = f"(select count(*)::double / sum(count(*)) over () as share from (select {VOTED.replace('vote', 'a.vote')} as f, {VOTED.replace('vote', 'b.vote')} as r from votes_faithfulness a join votes_relevance b using (id)) group by f, r)"
POINTS += [
    row("diagnostics", "const_share", f"select max(share) from {PAIRED}"), row("diagnostics", "output_entropy", f"select abs(-sum(share * log2(share))) from {PAIRED}"),
    row("diagnostics", "is_degenerate", f"select (max(share) > 0.98)::int from {PAIRED}"), row("diagnostics", "invalid_output_rate", "0"),
    row("diagnostics", "mean_per_repeat_f1", "select avg(f1) from repeats"), row("diagnostics", "sd_across_repeats", "select stddev_pop(f1) from repeats"),
    row("diagnostics", "operating_threshold", "select median(threshold) from fitted_reliable"), row("diagnostics", "threshold_sd", "select stddev_pop(threshold) from fitted_reliable"),
    "select 'repeats', 'f1.' || repeat, f1 from repeats", "select 'thresholds', repeat || '.' || fold, threshold from fitted_reliable",
    row("coverage", "corpus_n", "select count(*) from scores"), row("coverage", "n", "select count(*) from votes_reliable"), row("coverage", "excluded_n", "(select count(*) from scores) - (select count(*) from votes_reliable)"),
    row("comparison.b", "n_common", "select count(*) from compared"), row("comparison.b", "delta", f"(select {f1()} from (select {counts('y', 'p')} from compared)) - (select {f1()} from (select {counts('y', 'q')} from compared))"),
    row("comparison.b", "mcnemar_b", "select count(*) from compared where p = y and q <> y"), row("comparison.b", "mcnemar_c", "select count(*) from compared where p <> y and q = y"),
]
AT_WORK = f"""risk as (select 1 - y as bad, 1 - oof_score as risk, case when oof_score < (select median(threshold) from fitted_reliable) then 1 else 0 end as flag from votes_reliable),
  g as (select risk, count(*) as n, sum(bad)::bigint as pos from risk group by risk),
  cur as (select *, sum(n) over (order by risk desc)::double as flagged, sum(pos) over (order by risk desc)::double as hits, sum(pos) over ()::double as allpos, sum(n - pos) over (order by risk) - (n - pos) as below from g),
  at_work as (select * from (select count(*) as n, avg(bad::double) as base_rate, {counts('bad', 'flag')} from risk), (select sum(pos / allpos * (hits / flagged)) as ap, sum(pos * (below + (n - pos) / 2.0::double))::double / (sum(pos) * sum(n - pos)) as auc,
    coalesce(max(hits / allpos) filter (where hits / flagged >= 0.5::double), 0.0) as recall_at_50, coalesce(max(hits / allpos) filter (where hits / flagged >= 0.6::double), 0.0) as recall_at_60,
    coalesce(max(hits / allpos) filter (where hits / flagged >= 0.7::double), 0.0) as recall_at_70 from cur))"""
REPEATS = f"repeats as (select repeat, {f1()} as f1 from (select repeat, {counts('y', '(case when s >= threshold then 1 else 0 end)')} from judged_reliable join folds using (id) join fitted_reliable using (repeat, fold) group by repeat))"
COMPARED = f"compared as (select v.id, v.y, {VOTED} as p, case when o.p_faith * o.p_rel >= 0.3::double then 1 else 0 end as q from votes_reliable v join other o using (id))"
#: Resampled ends, their p and places in noise have no SQL.
RESAMPLED = ("ci_lo", "ci_hi", "null_percentile", "above_noise", "p", "significant", "mcnemar_p")


@query("k16_report_points", with_(CASES, A, B, FOLDS, GRID, *[of_axis(axis, *((RELIABLE, "p_faith * p_rel") if axis == "reliable" else names)) for axis, names in AXES.items()], AT_WORK, REPEATS, COMPARED)
    + "select section, name, round(value, 9) as value from (" + " union all ".join(POINTS) + ")")
def k16_points(spark, sf_dir):
    """All of the report that isn't resampled."""
    return r9(whole_report(spark, sf_dir).where(~F.col("name").isin(*RESAMPLED)), "value")


