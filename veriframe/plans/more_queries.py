"""Encoder inputs, entropy thresholds, seeds, assemblies and reports over cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import encoding, guards, inference, sampling, thresholds
from ..schemas import MARKERS
from .metric_queries import A, RANKED, RELIABLE, f1, r9
from .registry import query
from .text_queries import SPACE, chunk_list
from .views import CASES, MARKED, cases, marked_cases, scores, unit_sql, with_

BUDGET = 60


def ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}'), lambda w: w <> '')"


@query("x08_encoder_input", with_(CASES, f"p as (select id, {ws('question')} as h, {ws('answer')} as t, list_transform({chunk_list('context')}, lambda c: {ws('c')}) as cs from cases)",
    f"""q as (select *, len(t) >= {BUDGET} as alone, least(len(t), {BUDGET}) as nt, coalesce(list_sum(list_transform(cs, lambda c: len(c))), 0) as nc from p)""",
    f"r as (select *, case when alone then 0 else least(len(h), {BUDGET} - nt) end as nh from q)", f"s as (select *, case when alone then 0 else {BUDGET} - nt - nh end as room from r)")
    + """select id, (nh + least(room, nc) + nt)::bigint as n_tokens, len(list_filter(range(1, len(cs) + 1), lambda i: coalesce(list_sum(list_transform(cs[1:i - 1], lambda c: len(c))), 0) < room)) as n_chunks_kept,
      len(cs) as n_chunks_total, alone or nh < len(h) or nc > room as truncated from s""")  # fmt: skip
def x08(spark, sf_dir):
    b = encoding.budgeted(cases(spark, sf_dir), BUDGET)
    return b.select("id", F.size("tokens").alias("n_tokens"), "n_chunks_kept", "n_chunks_total", "truncated")


@query("x09_masked_labels", with_(CASES) + f"select id, least(len({ws('question')}), 40 - least(len({ws('answer')}), 20)) + least(len({ws('answer')}), 20) as n_input, least(len({ws('question')}), 40 - least(len({ws('answer')}), 20)) as n_ignored from cases")
def x09(spark, sf_dir):
    c = cases(spark, sf_dir)
    ids = lambda x: F.transform(x, lambda w: F.length(w))
    m = encoding.masked(ids(encoding.words(F.col("question"))), ids(F.slice(encoding.words(F.col("answer")), 1, 20)), 40)
    return c.select("id", m.alias("m")).select("id", F.size("m.input").alias("n_input"), F.size(F.filter("m.labels", lambda x: x == encoding.IGNORED)).alias("n_ignored"))


@query("k13_seeded_bootstrap")
def k13(spark, sf_dir):
    c = guards.with_reliable(cases(spark, sf_dir), name="y").select("id", "y")
    u = lambda k: (numeric.hash_unit(F.concat(F.lit(f"{k}:"), "id")) < 0.3 + 0.4 * F.col("y")).cast("int").alias(k)
    return inference.seeded_paired_bootstrap(c.select("id", "y", *[u(k) for k in ("p1", "p2", "m1", "m2")]), "y", ["p1", "p2"], ["m1", "m2"])


E5 = f"e5 as (select id, {RELIABLE} as y, 1 - p_faith as contra, p_rel as rel, floor({unit_sql("'e:' || id")} * 3) / 2.0::double as entropy from scores)"
GRID11 = "g11 as (select i, case when i = 10 then 1.0::double else i * 0.1::double end as t from range(11) g(i))"


def entropies(spark, sf_dir):
    s = guards.with_reliable(scores(spark, sf_dir), name="y")
    return s.select("id", "y", (1 - F.col("p_faith")).alias("contra"), F.col("p_rel").alias("rel"), (F.floor(numeric.hash_unit(F.concat(F.lit("e:"), "id")) * 3) / 2.0).alias("entropy"))


@query("k05_entropy_thresholds_coarse", with_(CASES, A, E5, GRID11, "ge as (select distinct entropy as te from e5 union select 'inf'::double)",
    "cells as (select a.t as t_contra, te as t_entropy, b.t as t_rel, " + ", ".join(f"count(*) filter (where y = {i} and (case when contra <= a.t and entropy <= te and rel >= b.t then 1 else 0 end) = {j}) as {n}" for i, j, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))) + " from e5, g11 a, g11 b, ge group by 1, 2, 3)")
    + f"select t_contra, t_entropy, t_rel, round({f1()}, 9) as macro_f1 from cells order by {f1()} desc, t_contra, t_entropy, t_rel limit 1")
def k05_coarse(spark, sf_dir):
    """An 11-point grid an axis, for the SQL; the whole search is k05_entropy_thresholds."""
    return r9(thresholds.fit_with_entropy(entropies(spark, sf_dir), "y", "contra", "rel", "entropy", steps=10), "macro_f1")


@query("k05_entropy_thresholds")
def k05(spark, sf_dir):
    return r9(thresholds.fit_with_entropy(entropies(spark, sf_dir), "y", "contra", "rel", "entropy"), "macro_f1")


@query("s07_assembly", with_(CASES, RANKED.replace("{by}", RELIABLE)) + """, parts as (select id, case when rank <= round_even(size * 0.8::double, 0) then 'train' when rank <= round_even(size * 0.8::double, 0) + round_even(size * 0.1::double, 0) then 'val' else 'test' end as split from ranked)
  select split, count(*) as n, sum(length(substr(question, 1, 100)))::bigint as chars, greatest(1, count(*) * 3 // 8)::bigint as iterations from parts join cases using (id) group by split""")  # fmt: skip
def s07(spark, sf_dir):
    c = guards.with_reliable(cases(spark, sf_dir), name="y").withColumn("question", F.substring("question", 1, 100))
    parts = sampling.split_80_10_10(c, "y")
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("question")).alias("chars"), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * 3 / 8)).alias("iterations"))


@query("g20_unknown_markers", with_(MARKED) + f"select marker || '_x' as marker, count(*) as n from marked where marker || '_x' not in ({', '.join(repr(m) for m in MARKERS)}) group by 1")
def g20(spark, sf_dir):
    codes = spark.createDataFrame([(m,) for m in MARKERS], "marker string")
    m = marked_cases(spark, sf_dir).select(F.concat("marker", F.lit("_x")).alias("marker"))
    return m.groupBy("marker").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(codes), "marker", "left_anti")


TERMS = ("erer", "hes", "qued", "zzz")


@query("t24_foreign_terms", with_(CASES) + "select id, array_to_string(list_filter([" + ", ".join(f"'{t}'" for t in TERMS) + "], lambda t: contains(lower(answer), t)), ',') as hits from cases")
def t24(spark, sf_dir):
    return cases(spark, sf_dir).select("id", F.array_join(F.filter(F.array(*[F.lit(t) for t in TERMS]), lambda t: F.contains(F.lower("answer"), t)), ",").alias("hits"))


