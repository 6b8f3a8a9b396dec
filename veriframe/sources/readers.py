"""Readers of cases, scores, predictions, folds and caches. Files are read by Spark, on any store it reaches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.guards import checked_cases, duplicates

FORMATS = {"csv": "csv", "zip": "csv", "json": "json", "jsonl": "jsonl"}


def detect_format(path: str) -> str:
    kind = FORMATS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")
    if kind is None:
        raise ValueError(f"format of {path} is not known")
    return kind


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line under a declared schema; a line that can't be read is an error, blank lines are
    skipped, unknown fields ignored."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    return checked_cases(jsonl(spark, path, schemas.CASE))


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line): lines that are no object of the schema; blank ones are none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.where(parsed["_bad"].isNotNull())


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A header line, quoted fields over several lines, a byte order mark left out; all columns strings."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Rows of the CSV file in each ZIP archive: the first one, or with strict the only one. Archives are
    the unit of work; inside one, rows leave in batches."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".csv") and not n.startswith("__MACOSX")]
                    if not names or (strict and len(names) > 1):
                        raise ValueError(f"expected {'one' if strict else 'a'} CSV file in the archive, found {names}")
                    with z.open(names[0]) as f:
                        for part in pd.read_csv(f, dtype=str, keep_default_na=False, encoding="utf-8-sig", chunksize=5000):
                            yield part.reindex(columns=list(columns), fill_value="")

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def raw_records(spark: SparkSession, path: str, renamed: Mapping[str, str], schema: str) -> DataFrame:
    """Raw CSV, JSON array or JSON lines with columns renamed."""
    kind = detect_format(path)
    df = csv(spark, path) if kind == "csv" else spark.read.schema(schema).option("multiLine", kind == "json").option("mode", "FAILFAST").json(path)
    return df.withColumnsRenamed(dict(renamed))


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(id, scores): rows that have p_faith and p_rel at their root and no map get them as legacy.* keys."""
    df = jsonl(spark, path, schemas.SCORES)
    legacy = F.create_map(F.lit("legacy.p_faith"), "p_faith", F.lit("legacy.p_rel"), "p_rel")
    has = F.coalesce(F.size("scores"), F.lit(0)) > 0
    found = df.select("id", F.when(has, F.col("scores")).when(F.col("p_faith").isNotNull() & F.col("p_rel").isNotNull(), legacy).alias("scores"))
    return found.where(F.when(found["id"].isNotNull() & found["scores"].isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no scores for "), F.coalesce("id", F.lit("a row without id")))).cast("boolean")))


def score_source(spark: SparkSession, path: str) -> DataFrame:
    """As scores; an id on two rows is an error, and so is no row."""
    df = scores(spark, path)
    twice = [r["id"] for r in duplicates(df).limit(5).collect()]
    if twice:
        raise ValueError(f"ids on several rows of {path}: {twice}")
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.PREDICTION)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos): order is what the rows say, as files have none."""
    return jsonl(spark, path, schemas.ID_LIST)


def folds(spark: SparkSession, path: str) -> DataFrame:
    """(id, repeat, fold) of a folds file; a section that is missing is an error."""
    df = spark.read.schema(schemas.FOLDS_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    whole = F.col("schema_version").isNotNull() & F.col("config.n_folds").isNotNull() & F.col("config.n_repeats").isNotNull() & F.col("assignment").isNotNull() & F.col("corpus.sha256").isNotNull()
    df = df.where(F.when(whole, True).otherwise(F.raise_error(F.lit("a section of the folds file is missing")).cast("boolean")))
    return df.select(F.explode("assignment").alias("id", "folds")).select("id", F.posexplode("folds").alias("repeat", "fold"))


def sample_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(id, samples) from one JSON file for each id; an entry without samples is an error."""
    df = spark.read.schema("samples array<string>").option("multiLine", True).json(folder).select(F.regexp_extract("_metadata.file_name", r"(.*)\.json$", 1).alias("id"), "samples")
    return df.where(F.when(df["samples"].isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no samples for "), "id")).cast("boolean")))


def response_cache(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """(key, choices) of the entries that are whole and have n choices; all others are misses."""
    df = spark.read.schema(f"key string, choices array<struct<{', '.join(f.replace(' ', ':', 1) for f in schemas.CHOICE.split(', '))}>>, _bad string").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return df.where(df["_bad"].isNull() & df["key"].isNotNull() & (F.size("choices") == n) & F.forall("choices", lambda c: c["text"].isNotNull())).select("key", "choices")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key"), "key", "left_anti")


def legacy_runs(spark: SparkSession, root: str) -> DataFrame:
    """(path, prefix, split): val, test and train files below a root and the score prefix their folder gives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root).select("path")
    split = F.regexp_extract("path", r"/(val|test|train)\.jsonl$", 1)
    prefix = F.when(F.contains("path", F.lit("/m3/")), "m3").when(F.contains("path", F.lit("/m6")), "m6").when(F.contains("path", F.lit("/surface")), "surf").otherwise("legacy")
    return files.select("path", prefix.alias("prefix"), split.alias("split")).where("split <> ''")


def config(text: str) -> dict:
    """A YAML text; an empty one is an error."""
    import yaml

    found = yaml.safe_load(text)
    if not found:
        raise ValueError("the configuration is empty")
    return found
