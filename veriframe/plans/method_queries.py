"""Methods by name over cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import methods
from ..operators.guards import contract
from .metric_queries import r9
from .registry import query
from .text_queries import RULES
from .views import CASES, FOLDS, cases, folds, with_


@query("u01_u02_rules_method", with_(CASES, RULES) + "select id, round(faith_score * question_coverage, 9) as score from rules")
def u01(spark, sf_dir):
    return r9(methods.combined(methods.run("rules", cases(spark, sf_dir))), "score")


@query("t23_keyword_method", with_(CASES) + """select id, case when contains(lower(context), lower(answer)) and answer <> '' then 1.0::double else 0.0::double end
  * case when contains(lower(answer), 'не знаю') or contains(lower(answer), 'не могу ответить') or contains(lower(answer), 'i don''t know') then 0.0::double else 1.0::double end as score from cases""")  # fmt: skip
def t23(spark, sf_dir):
    return methods.combined(methods.run("keywords", cases(spark, sf_dir)))


@query("m02_majority_method", with_(CASES, FOLDS, """own as (select repeat, fold, count(*) as n, sum(faithfulness) as f, sum(relevance) as r from folds join cases using (id) group by 1, 2)""",
    "whole as (select repeat, sum(n) as wn, sum(f) as wf, sum(r) as wr from own group by 1)") + """select id, round(avg((wf - f)::double / (wn - n)) * avg((wr - r)::double / (wn - n)), 9) as score from folds join own using (repeat, fold) join whole using (repeat) group by id""")
def m02(spark, sf_dir):
    return r9(methods.combined(methods.run("majority", cases(spark, sf_dir), folds(spark, sf_dir))), "score")


@query("m01_surface_method")
def m01(spark, sf_dir):
    return r9(methods.combined(methods.run("surface", cases(spark, sf_dir), folds(spark, sf_dir))), "score")


@query("a44_method_contracts", with_(CASES) + """select method, count(*) as n, count(*) filter (where cast(id as bigint) % 7 = 0) as n_lacking, count(*) filter (where cast(id as bigint) % 7 = 1) as n_not_finite
  from cases, (select unnest(['rules', 'keywords']) as method) group by method""")  # fmt: skip
def a44(spark, sf_dir):
    """Rows that break a method's contract, by method, where some scores were taken away or made infinite."""
    out, way = None, F.col("id").cast("bigint") % 7
    for name in ("rules", "keywords"):
        first = F.lit(methods.METHODS[name].keys[0])
        broken = F.when(way == 0, F.map_filter("scores", lambda k, v: k != first)).when(way == 1, F.transform_values("scores", lambda k, v: F.when(k == first, float("inf")).otherwise(v))).otherwise(F.col("scores"))
        c = contract(methods.run(name, cases(spark, sf_dir)).withColumn("scores", broken), methods.METHODS[name].keys)
        row = c.select(F.lit(name).alias("method"), "n", "n_lacking", "n_not_finite")
        out = row if out is None else out.unionByName(row)
    return out
