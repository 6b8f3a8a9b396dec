"""A cache of answer samples that is topped up: sample k of an id is made once, whatever n is asked for, and when."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, sample string, k int"
#: (id, prompt, k) to (id, k, sample).
Sampler = Callable[[DataFrame], DataFrame]


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """(id, sample, k) of what the cache holds; a folder that isn't there holds nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(SCHEMA).parquet(folder) if there else spark.createDataFrame([], SCHEMA)


def top_up(requests: DataFrame, folder: str, n: int, sampler: Sampler) -> DataFrame:
    """(id, samples): the first n samples of every id of requests (id, prompt), in order, after making those that the
    cache lacks.

    The cache is partitioned by k. Only partitions that lack an id are written, each whole, with the samples it
    had, in one commit that replaces those partitions: a run that dies leaves the cache as it was, a task
    that runs again writes the same place, and running twice adds nothing. What sampler leaves out stays
    missing for the next time; what it gives twice counts once. Null ids and samples are left out."""
    spark = requests.sparkSession
    had = cached(spark, folder)
    wanted = requests.where(F.col("id").isNotNull()).dropDuplicates(["id"]).select("id", "prompt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")) if n > 0 else None
    if wanted is not None:
        missing = wanted.join(had.select("id", "k"), ["id", "k"], "left_anti")
        lacking = [r["k"] for r in missing.select("k").distinct().collect()]  # n numbers at most
        if lacking:
            made = sampler(missing.select("id", "prompt", "k")).where(F.col("sample").isNotNull()).select("id", "sample", F.col("k").cast("int").alias("k"))
            made = made.join(missing.select("id", "k"), ["id", "k"], "left_semi").dropDuplicates(["id", "k"]).select("id", "sample", "k")
            whole = had.where(F.col("k").isin(lacking)).unionByName(made)
            whole.repartition("k", F.pmod(F.xxhash64("id"), F.lit(32))).write.partitionBy("k").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    found = cached(spark, folder).where(F.col("k") < n).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sample"))), lambda x: x["sample"]).alias("samples"))
    return requests.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
