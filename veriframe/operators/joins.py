"""Joins whose hot keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task should meet at most, where a caller knows no better.
KEY_ROWS = 100_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, spread: Column, limit: int = KEY_ROWS) -> DataFrame:
    """rows joined with table, which has one row a key and, as column n, the number of the key's rows.

    Rows of a key that has more than limit of them are dealt over n / limit parts by spread, a column
    that tells rows apart and never changes between reruns; the key's row in table is repeated once
    for each part, and no other is. The list of such keys goes to all tasks: it has at most one key
    for each limit rows. Null keys match nothing; repeated rows stay; n isn't returned."""
    parts = F.greatest(F.ceil(F.col(n) / limit), F.lit(1)).cast("int")
    hot = table.where(F.col(n) > limit).select(key, parts.alias("_parts"))
    part = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", part).drop("_parts")
    repeated = table.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return dealt.join(repeated, [key, "_part"]).drop("_part")


def self_pairs(rows: DataFrame, key: str, id_: str, keep: Column, limit: int = KEY_ROWS) -> DataFrame:
    """Pairs of rows of equal key and rising id, with columns a_<c> and b_<c> for each c but the key, that keep holds for.

    A key of more than limit rows is cut into blocks of about limit by a hash of the id, and its blocks
    meet as a triangle: every row goes to the cells of its block with each other, a pair meets in
    one cell, and no task holds more than two blocks of a key. keep is a condition on a_ and b_ columns.
    The list of such keys goes to all tasks: it has at most one key for each limit rows. Null keys and
    ids match nothing; rows of equal key and id aren't paired."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = counts.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(id_), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other"))
    side = lambda s: dealt.select(key, "_low", "_high", F.col("_block").alias(f"_{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c != key])
    met = side("a").join(side("b"), [key, "_low", "_high"]).where((F.col("_a_block") != F.col("_b_block")) | (F.col("_low") == F.col("_high")))
    return met.where((F.col(f"a_{id_}") < F.col(f"b_{id_}")) & keep).drop("_low", "_high", "_a_block", "_b_block")
