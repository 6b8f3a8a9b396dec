"""Files written and read again, caches, per-chunk judges and diffs, over cases and documents."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions.numeric import hash_unit
from ..operators import converters, diffs, perchunk
from ..session import checkpoint_folder
from ..sources import archives, readers, samples, writers
from ..streaming import incremental
from .metric_queries import A, r9
from .registry import query
from .text_queries import chunk_list
from .views import CASES, cases, scores, table, unit_sql, with_


def place(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}-{name}"


@query("a02_a03_csv", with_(CASES) + "select id, sha256(question) as question, sha256(coalesce(answer, '')) as answer, faithfulness::varchar as faithfulness from cases")
def a03(spark, sf_dir):
    """Quotes, commas and line ends inside fields, all columns as strings; a null field is an empty one."""
    path = place(spark, "cases.csv")
    c = cases(spark, sf_dir)
    c.select("id", "question", "answer", "faithfulness").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    kind = readers.detect_format(path)
    back = readers.raw_records(spark, path, {"question": "asked"}, "") if kind == "csv" else None
    return back.select("id", F.sha2(F.coalesce("asked", F.lit("")), 256).alias("question"), F.sha2(F.coalesce("answer", F.lit("")), 256).alias("answer"), "faithfulness")


@query("a04_zipped_csv", "select cast(doc_id as varchar) as doc_id, sha256(coalesce(text, '')) as text_sha256, coalesce(source, '') as source from documents")
def a04(spark, sf_dir):
    """All documents as archives, read back by the member."""
    path = place(spark, "archives")
    archives.write(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    back = archives.read(spark, path, ["doc_id", "source", "text"])
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "source")


@query("a05_raw_records", with_(CASES) + "select id, sha256(question) as question, relevance::bigint as relevance from cases")
def a05(spark, sf_dir):
    path = place(spark, "raw.jsonl")
    writers.jsonl(cases(spark, sf_dir).select(F.col("id").alias("key"), F.col("question").alias("asked"), "relevance"), path)
    back = readers.raw_records(spark, path, {"key": "id", "asked": "question"}, "key string, asked string, relevance int")
    return back.select("id", F.sha2("question", 256).alias("question"), "relevance")


@query("a08_predictions", with_(CASES, A) + "select id, case when p_faith >= 0.5::double then 1 else 0 end::bigint as faithfulness_pred, round(p_faith, 9) as p, length(id) % 5 = 0 as invalid_output from scores")
def a08(spark, sf_dir):
    path = place(spark, "predictions.jsonl")
    s = scores(spark, sf_dir)
    writers.jsonl(s.select("id", (F.col("p_faith") >= 0.5).cast("int").alias("faithfulness_pred"), F.lit(1).alias("relevance_pred"), F.col("p_faith").alias("faithfulness_prob"), (F.length("id") % 5 == 0).alias("invalid_output")), path)
    return r9(readers.predictions(spark, path).select("id", "faithfulness_pred", F.col("faithfulness_prob").alias("p"), "invalid_output"), "p")


@query("a09_id_list", with_(CASES) + "select id, cast(id as bigint) * 2 as pos from cases")
def a09(spark, sf_dir):
    path = place(spark, "ids.jsonl")
    writers.jsonl(cases(spark, sf_dir).select("id", (F.col("id").cast("bigint") * 2).alias("pos")), path)
    return readers.id_list(spark, path)


@query("a11_last_rows", "select source as id, max(doc_id) as last_doc, arg_max(n_chars, doc_id) as n_chars from documents where source is not null group by source")
def a11(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("id"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("last_doc"), "n_chars")
    return converters.last_by_id(d, "id", "pos").select("id", "last_doc", "n_chars")


@query("a15_provenance", """with raw as (select doc_id % 4 as k, quality, toxic from documents join labels using (doc_id))
  select count(*) as n, count(*) filter (where k > 0) as n_annotated, count(*) filter (where k > 1) as n_multi, count(*) filter (where quality = 1 and toxic = 0) as n_reliable, coalesce(sum(k), 0)::bigint as n_occurrences from raw""")  # fmt: skip
def a15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    items = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < F.col("doc_id") % 4, F.concat(F.lit("'m"), i.cast("string"), F.lit("'"))))
    raw = d.select(F.concat(F.lit("["), F.array_join(F.array_compact(items), ", "), F.lit("]")).alias("markers"), F.when(F.col("quality") == 1, "True").otherwise("0").alias("binary_faithfulness"), F.when(F.col("toxic") == 0, "1").otherwise("false").alias("binary_relevancy"))
    return converters.marker_provenance(raw)


@query("a16_response_cache", with_(CASES) + "select id as key, md5(question) as first from cases where cast(id as bigint) % 3 = 0")
def a16(spark, sf_dir):
    """Entries of two whole choices are hits; of one, or with a choice without text, misses."""
    path, way = place(spark, "responses"), F.col("id").cast("bigint") % 3
    choice = lambda text: F.struct(text.alias("text"), F.lit("stop").alias("finish_reason"))
    both = F.array(choice(F.col("question")), choice(F.when(way == 0, F.lit("b"))))
    writers.jsonl(cases(spark, sf_dir).select(F.col("id").alias("key"), F.when(way == 1, F.slice(both, 1, 1)).otherwise(both).alias("choices")), path)
    return readers.response_cache(spark, path, 2).select("key", F.md5(F.get("choices", F.lit(0))["text"]).alias("first"))


@query("b02_score_stream", with_(CASES, A) + "select id, round(p_faith, 9) as score from scores")
def b02(spark, sf_dir):
    """Scores written by a stream that sees half of the cases twice."""
    source, sink = place(spark, "stream-in"), place(spark, "stream-out")
    s = scores(spark, sf_dir).select("id", "p_faith")
    writers.jsonl(s, source)
    writers.jsonl(s.where(hash_unit(F.col("id")) < 0.5), source, "append")
    scored = lambda df: df.select("id", F.round("p_faith", 9).alias("score"))
    incremental.score_stream(spark, source, "id string, p_faith double", sink, place(spark, "stream-state"), scored).awaitTermination()
    return spark.read.schema("id string, score double").json(sink)


@query("b04_newest_entries", with_(CASES) + "select id as key, case when length(id) % 2 = 0 then 2 else 1 end::bigint as v from cases")
def b04(spark, sf_dir):
    path, c = place(spark, "entries"), cases(spark, sf_dir).select(F.col("id").alias("key"))
    writers.cache_entries(c.select("key", F.lit(1).alias("v")), path)
    writers.cache_entries(c.where(F.length("key") % 2 == 0).select("key", F.lit(2).alias("v")), path)
    return writers.newest(spark.read.parquet(path))


REFUSED = 0.1


def judge(asked):
    """Hashes in place of a model; what hashes low is refused."""
    unit = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32
    if any(unit(f"refuse:{chunk}") < REFUSED for *_, chunk in asked):
        raise ValueError("refused")
    return [unit(f"u06:{answer}|{chunk}") for _, answer, chunk in asked]


@query("u06_chunk_judge", with_(CASES, f"asked as (select id, answer, unnest({chunk_list('context')}) as c, unnest(range(1, len({chunk_list('context')}) + 1)) as chunk from cases)",
    f"said as (select id, chunk, case when {unit_sql("'refuse:' || c")} < {REFUSED}::double then null else {unit_sql("'u06:' || coalesce(answer, '') || '|' || c")} end as s from asked)",
    "lists as (select id, count(*) as n_chunks, count(*) filter (where s is null) as n_failed, list(s order by chunk) filter (where s is not null) as v from said group by id)")
    + """select id, n_chunks, n_failed, round(list_max(v), 9) as max_chunk_score, round(list_avg(v), 9) as mean_chunk_score, round(list_reverse_sort(v)[1] - coalesce(list_reverse_sort(v)[2], list_reverse_sort(v)[1]), 9) as chunk_disagreement,
      len(list_filter(v, lambda x: x > 0.5))::bigint as n_supporting, list_position(v, list_max(v))::bigint as argmax_chunk from lists""")  # fmt: skip
def u06(spark, sf_dir):
    judged = perchunk.judged_chunks(cases(spark, sf_dir), judge)
    return r9(perchunk.by_case(judged), "max_chunk_score", "mean_chunk_score", "chunk_disagreement")


@query("u10_sample_cache", with_(CASES) + "select id, 4::bigint as n, md5(question || '0,' || question || '1,' || question || '2,' || question || '3') as digest from cases")
def u10(spark, sf_dir):
    """Two top-ups, of some cases to two samples and of all to four."""
    folder, asked = place(spark, "samples"), cases(spark, sf_dir).select("id", F.col("question").alias("prompt"))
    sampler = lambda df: df.select("id", "k", F.concat("prompt", F.col("k").cast("string")).alias("sample"))
    samples.top_up(asked.where(hash_unit(F.col("id")) < 0.5), folder, 2, sampler)
    return samples.top_up(asked, folder, 4, sampler).select("id", F.size("samples").alias("n"), F.md5(F.array_join("samples", ",")).alias("digest"))


@query("t24_prompt_diff")
def t24(spark, sf_dir):
    """Every document against the one of the next id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")
    return diffs.line_diff(both, F.col("text"), F.col("next")).select("doc_id", "diff.*")
