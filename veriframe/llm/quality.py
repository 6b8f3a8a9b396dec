"""Quality rules on words, lines and repeats, and compression bands.

Each text is taken whole, in Arrow batches whose bytes Spark bounds. Texts are measured first; the limits
of a length class are then fitted to all that was measured, and what was measured is judged by them."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Compression bands: bytes before / bytes after compression, by length.

    Lengths fall into classes, steps of them to each doubling. In a class the fitted band is its median
    ratio and spread times its robust deviation (interquartile range / 1.349) to both sides, at least
    slack of the median. Median and squared deviation are means over the classes around, weighed by their
    different texts and by decay for each class between, so a rare length borrows from its neighbours; all
    neighbours together weigh support texts at most, and where their medians differ, the deviation
    holds that difference too.
    Where n texts count in this way, the band has n parts of the fitted limits and support parts of the
    outer ones, so it tightens steadily as texts come; it is never beyond the outer ones. A whole text outside the band of its length goes, and so does one of which more
    than odd_chunks of its chunks are outside the band of theirs. Chunks have chunk bytes; the rest of a
    text belongs to its last chunk, and a text under two chunks is one."""

    level: int = 3
    chunk: int = 4096
    steps: int = 4
    spread: float = 4.5
    slack: float = 0.06
    outer: tuple[tuple[float, float, float], ...] = ((256, 0.0, 3.0), (2048, 1.15, 4.0), (16384, 1.4, 5.0), (float("inf"), 1.5, 6.0))
    support: float = 6.0
    decay: float = 0.25
    reach: int = 8
    odd_chunks: float = 0.25


#: Ratios are counted in steps of one in so many when bands are fitted.
BINS = 1000
COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_bytes long, packed long, chunks array<struct<n_bytes:long,packed:long>>"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more in the text.

    Windows get numbers by doubling: pairs of word numbers, pairs of pairs, pairs of those. Equal
    numbers are equal windows, so nothing rests on a hash, and memory is a few numbers a word."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    step = 1
    while step < WINDOW:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        _, ids = np.unique(pairs, return_inverse=True)
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edges)[: len(words)] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line; a text without words has none."""
    lines = Counter(line for line in text.split("\n") if line.strip(SPACES))
    return sum(n - 1 for n in lines.values())


def chunk_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """Begin and end of a text's chunks; the last takes what is left behind it."""
    k = max(1, n // size)
    return [(i * size, (i + 1) * size if i < k - 1 else n) for i in range(k)]


def measured(text: str | None, pack, limits: Limits) -> tuple:
    """What COLUMNS names, of one whole text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: exactly the six ASCII spaces
    repeat = repeated_words(words)
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    whole = len(pack(data))
    bounds = chunk_bounds(len(data), limits.chunk)
    chunks = [{"n_bytes": len(data), "packed": whole}] if len(bounds) == 1 else [{"n_bytes": e - b, "packed": len(pack(data[b:e]))} for b, e in bounds]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat,
        failed, len(data), whole, chunks,
    )


def measure(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(doc, n_words ... chunks) for every row; doc holds the row as it came, so columns can't clash.

    A null text counts as an empty one: no words, failed, one empty chunk. Repeated rows each get their
    own row; an empty table gives none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=limits.level).compress
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measured(t, pack, limits) for t in texts], columns=names)

    return docs.select(F.struct("*").alias("doc"), F.pandas_udf(run, COLUMNS, F.PandasUDFType.SCALAR_ITER)(F.col(text)).alias("q")).select("doc", "q.*")


def length_class(n_bytes: Column, steps: int) -> Column:
    return F.floor(F.log2(F.greatest(n_bytes, F.lit(1)).cast("double")) * steps).cast("int")


def ratio(n_bytes: Column, packed: Column) -> Column:
    """Bytes before to bytes after; 0 for an empty text."""
    return n_bytes / F.greatest(packed, F.lit(1))


def fit(found: DataFrame, limits: Limits = Limits()) -> dict[int, tuple[float, float, float]]:
    """Length class to (low, high, share of the fitted band), from all texts of measure() that the base rules
    keep, whole and chunks.

    Texts of equal length and packed length count once, so a text copied a million times has one
    voice. Ratios are counted by class and step of 1/BINS, which is all that is sorted; classes are few
    (steps to a doubling), so one row for each comes to the driver. Classes within reach of one with a
    text get a band too; no rows give no classes."""
    each = found.where(~F.col("base_failed")).select(F.explode(F.array_distinct(F.concat("chunks", F.array(F.struct("n_bytes", "packed"))))).alias("c")).select("c.n_bytes", "c.packed").distinct()
    bins = each.groupBy(length_class(F.col("n_bytes"), limits.steps).alias("class"), F.floor(ratio(F.col("n_bytes"), F.col("packed")) * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    rows = bins.groupBy("class").agg(F.sum("n").alias("n"), F.percentile("bin", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q")).collect()
    known = {r["class"]: (r["n"], *((x + 0.5) / BINS for x in r["q"])) for r in rows}
    out = {}
    for k in {k + d for k in known for d in range(-limits.reach, limits.reach + 1)}:
        near = [(j, known[j][0] * limits.decay ** abs(j - k), known[j]) for j in sorted(known) if abs(j - k) <= limits.reach]
        lent = min(1.0, limits.support / max(1e-9, sum(w for j, w, _ in near if j != k)))
        near = [(w if j == k else w * lent, x) for j, w, x in near]
        n = sum(w for w, _ in near)
        middle = sum(w * x[2] for w, x in near) / n
        apart = sum(w * (((x[3] - x[1]) / 1.349) ** 2 + (x[2] - middle) ** 2) for w, x in near) / n
        wide = max(limits.spread * apart**0.5, limits.slack * middle)
        out[k] = middle - wide, middle + wide, n / (n + limits.support)
    return out


def judge(found: DataFrame, bands: dict[int, tuple[float, float, float]], limits: Limits = Limits()) -> DataFrame:
    """What measure() gives with ratio, n_chunks, low_chunks, high_chunks and kept."""
    pair = lambda low, high, share: F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(share).alias("share"))
    of_class = F.create_map(*[x for k, band in sorted(bands.items()) for x in (F.lit(k), pair(*band))]) if bands else None

    def outer(n: Column) -> Column:
        return F.coalesce(*[F.when(n <= up_to, pair(low, high, 0.0)) for up_to, low, high in limits.outer])

    def out_of(n: Column, packed: Column, high: bool) -> Column:
        side, beyond = ("high", operator.gt) if high else ("low", operator.lt)
        r, least = ratio(n, packed), outer(n)[side]
        if not bands:
            return beyond(r, least)
        mixed = let(F.try_element_at(of_class, length_class(n, limits.steps)), lambda b: b["share"] * b[side] + (1 - b["share"]) * least)
        return beyond(r, least) | F.coalesce(beyond(r, mixed), F.lit(False))

    judged = found.withColumn("ratio", ratio(F.col("n_bytes"), F.col("packed"))).withColumn("n_chunks", F.size("chunks").cast("bigint"))
    odd = lambda high: F.size(F.filter("chunks", lambda c: out_of(c["n_bytes"], c["packed"], high))).cast("bigint")
    judged = judged.withColumn("low_chunks", odd(False)).withColumn("high_chunks", odd(True))
    whole = ~out_of(F.col("n_bytes"), F.col("packed"), False) & ~out_of(F.col("n_bytes"), F.col("packed"), True)
    fits = whole & (F.col("low_chunks") + F.col("high_chunks") <= F.lit(limits.odd_chunks) * F.col("n_chunks"))
    return judged.withColumn("kept", ~F.col("base_failed") & fits)


def assess(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(doc, n_words ... kept) for every row: measured once, stored, and judged by bands fitted to all rows.

    Nulls, empty texts, repeated rows and empty tables as in measure(); a text without words is not kept."""
    found = materialise(measure(docs, text, limits))
    return judge(found, fit(found, limits), limits)


def keep(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that pass, with their own columns; a null or empty text never does."""
    return assess(docs, text, limits).where("kept").select("doc.*")
