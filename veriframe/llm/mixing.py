"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: The offset is a multiple of 2^-20, so rank * expected + offset keeps its fraction exactly where expected is a whole number.
OFFSET_STEPS = 1 << 20
#: Rows that one cell of the ordering should hold at most, by its mean.
CELL_ROWS = 20_000
LEAST_BUCKETS = 64


def number(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def row_digest(columns: Sequence[str]) -> Column:
    """A hex digest of all columns, nulls told apart from empty texts."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}))


def order_key(doc_id: Column, digest: Column) -> Column:
    """What rows are ordered by: a digest of the id, then of the rest. Where the id is null the rest
    leads, so that rows without one are dealt over all buckets."""
    return F.concat(F.coalesce(F.md5(doc_id.cast("string")), digest), digest)


def size_class(size: Column) -> Column:
    """Sixteen classes to each doubling of the size, so sizes of a class differ by 6 % at most."""
    bits = F.length(F.bin(size))
    top = F.substring(F.bin(size), 1, 5)
    return F.when(size < 16, size).otherwise(bits * 32 + F.conv(top, 2, 10).cast("bigint")).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(no_source, source, source_size, target) from one row for each source.

    Sources rank by code point, null last, and take the weights in turn. Together they are due
    share times all words. A source stops at most times its own words and the rest goes to the
    others by weight. With sources ordered by cap/weight, the first k stop and the level of the
    others is (due - their caps) / (weight left); k is the first for which the next source's cap
    is not below that level. The input has one row a source, so the window over all of it is small."""
    name = Window.orderBy("no_source", "source")
    ranked = sizes.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(name) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("turn", F.col("cap") / F.col("w"))
    everything = Window.orderBy("turn", "no_source", "source")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    reached = F.min(F.when(F.col("turn") >= F.col("level"), F.struct("turn", "no_source", "source", "level"))).over(whole)["level"]
    return levels.withColumn("target", F.least(F.col("cap"), F.coalesce(reached, F.lit(float("inf"))) * F.col("w"))).select(
        "no_source", "source", "source_size", "target"
    )


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def systematic_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None, key: Column | None = None, seed: int = 7,
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """(doc, size, source_size, target, copies) for every row; doc holds the row as it came.

    Size counts words, 0 for a null or empty text, unless a size of its own is given; that should be
    stored and not counted anew, as docs is read more than once. In its source each document is due
    target/source_size copies. Sums of those run through the source's documents in order of size
    class, then key, which is order_key() of the id and of all columns unless one is given; so only rows
    that are equal in every column tie, and reruns agree in whatever order rows come. One random offset for each source is added, and a document is taken once for
    each whole number its sum passes. All documents of a source are due as much, so the sum is the
    rank times that. Ordering by size spreads the copies over small and large texts alike, and what
    a source takes comes near its target.

    No source is ever in one task: ranks are added up from counts over size classes, then over
    hash buckets of a class, then inside a bucket, and a class that holds many rows gets its rows
    from many buckets. Repeated rows are separate documents; rows without an id are ordered by their
    other columns. Rows equal in every column share a bucket, which is sorted and numbered row by row,
    not held. A source without words is due nothing; its size and target are 0. An empty table gives no rows. Extra columns travel inside doc and cannot clash."""
    total = docs.count()
    buckets = LEAST_BUCKETS
    while buckets * CELL_ROWS < total:
        buckets *= 2
    rows = docs.select(
        F.struct("*").alias("doc"), (n_words(F.col(text)) if size is None else size).alias("size"),
        F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source), F.lit("")).alias("source"),
        (order_key(F.col(doc_id), row_digest(docs.columns)) if key is None else key).alias("key"),
    )
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn("bucket", F.floor(number(F.col("key")) * buckets / F.lit(float(1 << 32))))
    group, cell = ["no_source", "source", "class"], ["no_source", "source", "class", "bucket"]
    cells = materialise(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    groups = cells.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = groups.groupBy("no_source", "source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.select(*group, before(*group).alias("start")).join(targets, ["no_source", "source"])
    starts = cells.select(*cell, before(*cell).alias("inside")).join(starts, group)
    offset = (number(F.md5(F.concat(F.lit(f"{seed}:"), F.col("no_source").cast("string"), F.lit(":"), F.col("source")))) % OFFSET_STEPS) / F.lit(float(OFFSET_STEPS))
    local = F.row_number().over(Window.partitionBy(*cell).orderBy("key", "size")) - 1
    ranked = rows.withColumn("local", local).join(starts, cell)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = ranked.withColumn("rank", F.col("start") + F.col("inside") + F.col("local")).withColumn("due", due).withColumn("offset", offset)
    copies = F.floor((F.col("rank") + 1) * F.col("due") + F.col("offset")) - F.floor(F.col("rank") * F.col("due") + F.col("offset"))
    return ranked.select("doc", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each row as often as systematic_copies takes it, with its own columns.

    Nulls, empty texts, ties and repeated rows are treated as there; an empty table gives none. The same
    rows in any order give the same mix."""
    taken = systematic_copies(docs, **options).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
