"""Writers. Output is a folder of parts; one file is made only where a contract asks for it."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def provenance(df: DataFrame, path: str, *, method: str, args: dict, seed: int, partial: bool) -> None:
    """One row about a run: arguments, seed, rows, a hash of the arguments, time."""
    spark = df.sparkSession
    text = json.dumps(args, sort_keys=True, ensure_ascii=False)
    row = (method, text, hashlib.sha256(text.encode()).hexdigest(), seed, df.count(), partial, datetime.now(timezone.utc).isoformat(), uuid.uuid4().hex)
    schema = "method string, args string, args_sha256 string, seed int, n long, partial boolean, at string, run string"
    spark.createDataFrame([row], schema).write.mode("append").json(path)


def cache_entries(df: DataFrame, path: str, key: str = "key") -> None:
    """Appends entries; writers that race add equal rows, and newest() reads one."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def newest(df: DataFrame, key: str = "key") -> DataFrame:
    rest = [c for c in df.columns if c not in (key, "written_at")]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "written_at").alias("v")).select(key, "v.*")


def folds_file(folds: DataFrame, *, corpus_sha256: str, n_folds: int, seed: int) -> DataFrame:
    """One row of the folds file: assignment as a map from id to the fold of each repeat. A file is one
    value by its format; tables of folds are for more ids than a value should hold."""
    per_id = folds.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("repeat", "fold"))), lambda x: x["fold"]).alias("fs"))
    one = per_id.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "fs")))).alias("assignment"), F.max(F.size("fs")).alias("r"), F.count(F.lit(1)).alias("n"))
    return one.select(
        F.lit(1).alias("schema_version"), F.struct(F.lit("").alias("path"), F.lit(corpus_sha256).alias("sha256"), F.col("n").cast("int").alias("n")).alias("corpus"),
        F.struct(F.lit(n_folds).alias("n_folds"), F.col("r").alias("n_repeats"), F.lit(seed).alias("seed")).alias("config"), "assignment",
    )


def report(primary: DataFrame, *, method: str, variant: str) -> DataFrame:
    """A report row from (value, lo, hi); a value without an interval is an error."""
    ok = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    ci = F.when(ok, F.array("lo", "hi")).otherwise(F.raise_error(F.lit("no interval for the primary metric")).cast("array<double>"))
    return primary.select(F.lit(1).alias("schema_version"), F.lit(method).alias("method"), F.lit(variant).alias("variant"), F.struct("value", ci.alias("ci95")).alias("primary"))


def report_json(rows: DataFrame, *, method: str, variant: str, protocol: dict | None = None) -> DataFrame:
    """One row (json) of a report's rows (section, name, value): schema_version, method, variant, protocol, and for each
    section a map of its names. A primary or axis metric without both ends of its interval or its place in
    the noise is an error, as is a report without a primary metric."""
    needed = ("value", "ci_lo", "ci_hi", "null_percentile")
    by = rows.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("values"))
    metric = (F.col("section") == "primary") | F.startswith("section", F.lit("axis."))
    whole = F.forall(F.array(*map(F.lit, needed)), lambda n: F.exists("values", lambda x: (x["name"] == n) & x["value"].isNotNull()))
    checked = by.withColumn("values", F.when(~metric | whole, F.col("values")).otherwise(F.raise_error(F.concat(F.lit("a metric without interval or noise percentile: "), "section"))))
    sections = F.array_sort(F.collect_list(F.struct("section", "values")))
    one = checked.agg(F.map_from_entries(F.transform(sections, lambda s: F.struct(s["section"], F.map_from_entries(s["values"])))).alias("sections"))
    there = F.when(F.map_contains_key("sections", "primary"), F.col("sections")).otherwise(F.raise_error(F.lit("no primary metric")))
    head = [F.lit(1).alias("schema_version"), F.lit(method).alias("method"), F.lit(variant).alias("variant"), F.lit(json.dumps(protocol or {}, sort_keys=True, ensure_ascii=False)).alias("protocol")]
    return one.select(F.to_json(F.struct(*head, there.alias("sections"))).alias("json"))


def migrated(scores: DataFrame, prefix: str, expected: int) -> DataFrame:
    """Root p_faith and p_rel moved to keys of the prefix, keys that are there kept, partial where rows
    fall short of those expected; doing it again changes nothing."""
    added = F.map_filter(F.create_map(F.lit(f"{prefix}.p_faith"), "p_faith", F.lit(f"{prefix}.p_rel"), "p_rel"), lambda k, v: v.isNotNull())
    old = F.coalesce("scores", F.create_map().cast("map<string,double>"))
    new = F.map_filter(added, lambda k, v: ~F.map_contains_key(old, k))
    n = scores.count()
    return scores.select("id", F.map_concat(old, new).alias("scores"), F.lit(n < expected).alias("partial"))
