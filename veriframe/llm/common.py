"""Small pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, materialise

__all__ = ["checkpoint_folder", "materialise"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids kept from every fit; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def row_key(doc_id: str, text: str) -> Column:
    """Equal for rows of equal id and text, nulls included, and never null."""
    return F.md5(F.concat_ws("\x00", F.col(doc_id).isNull().cast("string"), F.col(text).isNull().cast("string"), F.col(doc_id).cast("string"), F.col(text)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


#: Elements that a running value goes over at a time.
STRETCH = 256


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column], block: int = STRETCH) -> Column:
    """For an array, join of zero and of what stands before each element (join must be associative).

    It goes over blocks first and then inside each block, so n elements cost about n * block
    steps and not n * n."""
    total = lambda a: F.aggregate(a, zero, join)

    def inside(a: Column, before: Column) -> Column:
        one = lambda b: let(
            F.slice(a, b * block + 1, F.lit(block)),
            lambda s: F.transform(upto(F.size(s)), lambda i: join(F.get(before, b), total(F.slice(s, F.lit(1), i)))),
        )
        return F.flatten(F.transform(upto(F.size(before)), one))

    def outer(a: Column) -> Column:
        n_blocks = F.ceil(F.size(a) / block).cast("int")
        blocks = F.transform(upto(n_blocks), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
        before = let(blocks, lambda s: F.transform(upto(F.size(s)), lambda i: total(F.slice(s, F.lit(1), i))))
        return let(before, lambda o: inside(a, o))

    return let(values, outer)


def running_offsets(steps: Column) -> Column:
    """For an array of numbers, what stands before each: 0, s0, s0+s1, ... (bigint)."""
    return running(steps, F.lit(0).cast("bigint"), lambda x, y: x + y)


def hash_fraction(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def labelled_sample(df: DataFrame, label: str, key: str, per_label: int, seed: int) -> DataFrame:
    """About per_label rows of each label, chosen by a hash of the key; null labels go.

    Adds weight, the rows of its label that each row stands for. The counts are over all rows;
    a row stays when its hash is below the label's share, so no window or sort is needed and
    reruns agree. Labels must be few (classes, languages): one row each is broadcast, and their
    number is checked."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    known = counts.limit(MAX_LABELS + 1).collect()
    if len(known) > MAX_LABELS:
        raise ValueError(f"{label} has more than {MAX_LABELS} values; it is no label")
    if not known:
        return df.where(F.lit(False)).withColumn("weight", F.lit(1.0))
    share = F.create_map(*[F.lit(x) for r in known for x in (r[0], min(1.0, per_label / r[1]))])
    picked = df.where(F.col(label).isNotNull()).withColumn("_share", share[F.col(label)])
    return picked.where(hash_fraction(F.col(key), seed) < F.col("_share")).withColumn("weight", 1.0 / F.col("_share")).drop("_share")


#: More values than this are taken for a mistake and not for labels.
MAX_LABELS = 10_000
