"""The tables in sf_dir seen as cases, scores, folds and dialogs, in Spark and as SQL.

A case is a labelled document: its first line is the question, its last the answer, the lines
between are numbered chunks of the context. Scores are numbers made from hashes and leaning to the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import hash_unit
from ..functions.text import first_chunk_key, query_key

N_FOLDS, N_REPEATS = 5, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(middle: Column) -> Column:
    """The context of lines: numbered chunks."""
    return F.array_join(F.transform(middle, lambda x, i: F.concat(F.lit("[CHUNK "), (i + 1).cast("string"), F.lit("]\n"), x)), "\n\n")


def between(ls: Column, most: Column) -> Column:
    """The lines between the first and the last, at most so many."""
    return F.when(F.size(ls) > 2, F.slice(ls, F.lit(2), F.least(F.size(ls) - 2, most))).otherwise(F.array().cast("array<string>"))


def labelled(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select(F.col("doc_id").cast("string").alias("id"), *columns, F.col("quality").cast("int").alias("faithfulness"), (1 - F.col("toxic")).cast("int").alias("relevance"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    lines = docs.join(labels, "doc_id").select("doc_id", "quality", "toxic", F.split("text", "\n").alias("ls"))
    ls = F.col("ls")
    return labelled(lines, F.get(ls, F.lit(0)).alias("question"), numbered(between(ls, F.size(ls))).alias("context"), F.try_element_at(ls, F.lit(-1)).alias("answer"))


def case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, query, chunk, faithfulness, relevance) of cases: keys of their questions and first chunks, null where empty.

    They are cut out before the join, so texts are not shuffled for them. A first chunk ends at the second one at
    the latest, so two are enough; whether a line is the last shows in a text's first five parts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", 5).alias("ls"))
    first = docs.select("doc_id", F.get("ls", F.lit(0)).alias("question"), numbered(between(F.col("ls"), F.lit(2))).alias("context"))
    keys = first.select("doc_id", F.nullif(query_key(F.col("question")), F.lit("")).alias("query"), first_chunk_key(F.col("context")).alias("chunk"))
    return labelled(keys.join(table(spark, sf_dir, "labels"), "doc_id"), "query", "chunk")


CASES = """cases as (
  select cast(doc_id as varchar) as id, ls[1] as question,
    case when len(ls) > 2 then array_to_string(list_transform(ls[2:-2], lambda x, i: '[CHUNK ' || i || ']' || chr(10) || x), chr(10) || chr(10)) else '' end as context,
    ls[-1] as answer, quality as faithfulness, 1 - toxic as relevance
  from (select doc_id, quality, toxic, string_split(text, chr(10)) as ls from documents join labels using (doc_id)))"""


def marked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with a marker for the unreliable ones."""
    f, r = F.col("faithfulness"), F.col("relevance")
    marker = F.when((f == 1) & (r == 1), "none").when(f == 0, F.when(hash_unit(F.concat(F.lit("m:"), "id")) < 0.5, "hallucination").otherwise("contradiction")).otherwise("off_topic_answer")
    return cases(spark, sf_dir).withColumn("marker", marker)


def unit_sql(key: str) -> str:
    return f"(cast('0x' || substr(md5({key}), 1, 8) as bigint) / 4294967296.0::double)"


MARKED = CASES + f""", marked as (
  select *, case when faithfulness = 1 and relevance = 1 then 'none'
    when faithfulness = 0 then (case when {unit_sql("'m:' || id")} < 0.5 then 'hallucination' else 'contradiction' end)
    else 'off_topic_answer' end as marker from cases)"""


def blended(run: str, axis: str, label: Column, lean: float) -> Column:
    return F.lit(lean) * label + F.lit(1 - lean) * hash_unit(F.concat(F.lit(f"{run}:{axis}:"), F.col("id")))


def scores(spark: SparkSession, sf_dir: str, run: str = "a", lean: float = 0.25) -> DataFrame:
    """Cases with p_faith and p_rel of a run."""
    c = cases(spark, sf_dir).select("id", "faithfulness", "relevance", "answer", "question")
    return c.select("*", blended(run, "f", F.col("faithfulness"), lean).alias("p_faith"), blended(run, "r", F.col("relevance"), lean).alias("p_rel"))


def scores_sql(run: str = "a", lean: float = 0.25, name: str = "scores") -> str:
    one = lambda axis, label: f"({lean}::double * {label} + {1 - lean}::double * {unit_sql(f"'{run}:{axis}:' || id")})"
    return f"{name} as (select id, faithfulness, relevance, answer, question, {one('f', 'faithfulness')} as p_faith, {one('r', 'relevance')} as p_rel from cases)"


def folds(spark: SparkSession, sf_dir: str, n_folds: int = N_FOLDS, n_repeats: int = N_REPEATS) -> DataFrame:
    """(id, repeat, fold): cases of one question are in one fold; one case in twenty is left out."""
    # As in cases(), but the question is cut out before the join, so texts are not shuffled for it.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("question"))
    c = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "question")
    c = c.where(hash_unit(F.concat(F.lit("out:"), "question")) >= 0.05)
    each = c.select("id", "question", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))
    return each.select("id", "repeat", F.floor(hash_unit(F.concat(F.col("repeat").cast("string"), F.lit(":"), "question")) * n_folds).cast("int").alias("fold"))


FOLDS = f"""folds as (
  select id, r as repeat, cast(floor({unit_sql("r || ':' || question")} * {N_FOLDS}) as bigint) as fold
  from cases, range({N_REPEATS}) t(r) where {unit_sql("'out:' || question")} >= 0.05)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
