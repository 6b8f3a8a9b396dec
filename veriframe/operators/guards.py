"""Constraints that fail loudly, and the rows that break them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MARKERS


def case_violations(cases: DataFrame) -> DataFrame:
    """(id, reason) of cases outside their domain: labels not 0 or 1, a marker that isn't one of the codes."""
    reasons = F.array_compact(F.array(
        F.when(F.col("id").isNull(), "id"), F.when(~F.coalesce(F.col("faithfulness").isin(0, 1), F.lit(False)), "faithfulness"),
        F.when(~F.coalesce(F.col("relevance").isin(0, 1), F.lit(False)), "relevance"), F.when(F.col("marker").isNotNull() & ~F.col("marker").isin(*MARKERS), "marker"),
    ))
    return cases.select("id", F.explode(reasons).alias("reason"))


def checked_cases(cases: DataFrame) -> DataFrame:
    """The cases; reading one outside its domain is an error."""
    fine = F.col("faithfulness").isin(0, 1) & F.col("relevance").isin(0, 1) & (F.col("marker").isNull() | F.col("marker").isin(*MARKERS))
    return cases.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("case outside its domain: "), F.col("id"))).cast("boolean")))


def with_reliable(df: DataFrame, faithfulness: str = "faithfulness", relevance: str = "relevance", name: str = "reliable") -> DataFrame:
    return df.withColumn(name, ((F.col(faithfulness) == 1) & (F.col(relevance) == 1)).cast("int"))


def duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of keys on more than one row."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing(wanted: DataFrame, given: DataFrame, key: str = "id") -> DataFrame:
    return wanted.select(key).join(given.select(key), key, "left_anti")


def require_aligned(wanted: DataFrame, given: DataFrame, key: str = "id") -> None:
    """An error that lists the first five keys given twice or not at all."""
    for what, found in (("duplicate", duplicates(given, key)), ("missing", missing(wanted, given, key))):
        first = [r[0] for r in found.select(key).orderBy(key).limit(5).collect()]
        if first:
            raise ValueError(f"{what} {key}: {first}")


def good_score_keys(scores: Column) -> Column:
    """True if all keys read `<method>.<signal>`."""
    return F.forall(F.map_keys(scores), lambda k: F.contains(k, F.lit(".")) & ~F.startswith(k, F.lit(".")) & ~F.endswith(k, F.lit(".")))


def contract(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct ids, rows that lack one of the keys, rows with a value that is null or not finite."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    lacks = ~F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.array_contains(F.map_keys("scores"), k))
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(lacks).alias("n_lacking"),
        F.count_if(F.exists(F.map_values("scores"), bad)).alias("n_not_finite"), F.count_if(~good_score_keys(F.col("scores"))).alias("n_bad_keys"),
    )


def unit_interval(x: Column) -> Column:
    """x, or an error where it is null, not a number or outside [0, 1]."""
    return F.when(x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0), x).otherwise(F.raise_error(F.concat(F.lit("score outside [0, 1]: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("double"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, content): the same for the same rows in any order."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("content"))


def file_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
