"""Samples and splits by hashes: the same rows wherever and how often they run.

Ranks inside a stratum are counted per hash bucket first, so a stratum that holds most rows is
never sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_unit

BUCKETS = 256


def stratum_rank(df: DataFrame, strata: Sequence[str], seed: str, id_: str = "id") -> DataFrame:
    """df with rank (from 1, by hash of the id) and size inside each stratum."""
    keyed = df.withColumn("_u", hash_unit(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")))).withColumn("_b", F.floor(F.col("_u") * BUCKETS).cast("int"))
    counts = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole, upto = Window.partitionBy(*strata), Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*strata, "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    local = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_u", id_))
    ranked = keyed.withColumn("_local", local).join(counts, [*strata, "_b"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_local")).drop("_u", "_b", "_before", "_local")


def split_80_10_10(df: DataFrame, label: str, seed: str = "42", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """df with split: the first shares of each label by rank, rounded half to even."""
    r = stratum_rank(df, [label], seed)
    n_train, n_val = F.bround(F.col("size") * train), F.bround(F.col("size") * val)
    return r.withColumn("split", F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")).drop("rank", "size")


def balanced(df: DataFrame, strata: Sequence[str], n: int, seed: str = "42") -> DataFrame:
    """n rows of each stratum: without repeats where it has as many, else each row again in turn; adds replica."""
    r = stratum_rank(df, strata, seed)
    last = F.greatest(F.lit(0), F.floor((n - F.col("rank")) / F.col("size"))).cast("int")
    kept = r.where(F.col("rank") <= n).withColumn("replica", F.explode(F.sequence(F.lit(0), F.when(F.col("size") >= n, F.lit(0)).otherwise(last))))
    return kept.drop("rank", "size")


def cyclic_oversample(df: DataFrame, strata: Sequence[str], seed: str = "42") -> DataFrame:
    """Every stratum brought to the size of the largest, its rows taken in turn; adds replica."""
    r = stratum_rank(df, strata, seed)
    most = F.broadcast(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most")))
    last = F.floor((F.col("most") - F.col("rank")) / F.col("size")).cast("int")
    return r.crossJoin(most).withColumn("replica", F.explode(F.sequence(F.lit(0), last))).drop("rank", "size", "most")


def oversample_negatives(df: DataFrame, label: str, seed: str = "42") -> DataFrame:
    """Negatives brought to as many as positives by repeats of rows in turn; positives stay; adds replica."""
    r = stratum_rank(df, [label], seed)
    sizes = F.broadcast(df.agg(F.count_if(F.col(label) == 1).alias("pos")))
    last = F.when(F.col(label) == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((F.col("pos") - F.col("rank")) / F.col("size"))).cast("int"))
    return r.crossJoin(sizes).withColumn("replica", F.explode(F.sequence(F.lit(0), last))).drop("rank", "size", "pos")


def stratified_subsample(df: DataFrame, size: int, label: str, seed: str = "0") -> DataFrame:
    """Exactly size rows (all if fewer): positives by their share, rounded down, the rest negatives."""
    r = stratum_rank(df, [label], seed)
    sizes = F.broadcast(df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")))
    take = F.least(F.lit(size), F.col("n"))
    pos = F.greatest(F.floor(take * F.col("pos") / F.greatest(F.col("n"), F.lit(1))), take - (F.col("n") - F.col("pos")))
    return r.crossJoin(sizes).where(F.col("rank") <= F.when(F.col(label) == 1, pos).otherwise(take - pos)).drop("rank", "size", "n", "pos")


def first_by_hash(df: DataFrame, n: int, seed: str, id_: str = "id") -> DataFrame:
    """n rows chosen by hash: a top-n that every task makes for itself first."""
    key: Column = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")))
    return df.orderBy(key, id_).limit(n)
