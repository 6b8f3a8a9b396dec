"""Groups of spelling variants, found by a dictionary of pairs of trie nodes.

The nodes of a trie over the words and of one over the reversed words have numbers. A word cut
before its character i is a pair (node of what stands before, node of what follows); with character
i left out it is the pair (node before i, node after i). Two words differ

* by a replacement at i where both give the same pair with i left out: for one i only;
* by an insertion where the longer one, with i left out, gives a pair that the shorter one gives
  whole. The places i that do so are a run of one character; only the first of a run counts.

So near words are found by equality of two integers, each pair of words once. The words of one pair
with a character left out differ in that character, so their number is bounded by the alphabet, and
the whole words of one pair are one word. A word needs of the others how many there are and which is
the most frequent, so a group is never written out as pairs.

The tries are numbered by one pass over the sorted words, as a word has the nodes of the one before
up to where they part. Words are dealt over parts by splitters; the nodes on a splitter's path have
numbers that all parts know, and any node that two parts share is on such a path: both words lie at
different sides of a splitter, so what they begin with alike, the splitter begins with as well."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, materialise

#: Letters of a run, once A-Z are lower-cased.
LETTERS = r"[a-zÀ-ÿ]"
#: Code points and occurrences that a word must have at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: How many times as frequent as a word its form must be.
DOMINANCE = 5
#: Different words, and characters of theirs, that a task holds before it passes its counts on.
HELD, HELD_CHARS = 400_000, 16_000_000
#: Words of a part of a trie, parts at most, sampled words for each part and the length splitters are cut to.
PART_WORDS, PARTS, SAMPLED, SPLITTER = 20_000, 2048, 50, 64
#: Numbers of one part's nodes, and of its words.
SPAN = 1 << 40
#: Pairs sent on at a time.
PAIRS = 1 << 17
#: A word's part in a pair: whole, or with a character left out that is the first of a run, or another.
WHOLE, FIRST, LATER = 0, 1, 2


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_every: int | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): how often each maximal run of LETTERS stands in all texts, A-Z lower-cased.

    With drop_every, a run for which it divides h, the unsigned CRC-32 of '<key>:<run>' in UTF-8,
    loses its code point h % length first. Words shorter than least_length go. A null text has no
    words, a null key is an empty one, repeated rows count each. Counts are added up in each task
    before they are shuffled."""
    runs = re.compile(LETTERS + "{%d,}" % least_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        chars = 0
        for batch in batches:
            for k, t in zip(batch["key"], batch["text"], strict=True):
                if not t:
                    continue
                found = Counter(runs.findall(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))  # of bytes: A-Z only
                head = zlib.crc32(f"{k}:".encode()) if drop_every else 0
                for w, n in found.items():
                    if drop_every and (h := zlib.crc32(w.encode(), head)) % drop_every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least_length:
                            continue
                    if w not in held:
                        chars += len(w)
                    held[w] += n
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held, chars = Counter(), 0
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    given = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return given.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def paths(splitters: list[str]) -> dict[str, int]:
    """Numbers of the nodes on the splitters' paths; 0 is the root's."""
    numbers = {"": 0}
    for s in splitters:
        for d in range(1, len(s) + 1):
            numbers.setdefault(s[:d], len(numbers))
    return numbers


class Trie:
    """Numbers the nodes of a trie, fed with (part, word) in order; splitters cut the words into parts."""

    def __init__(self, splitters: list[str]):
        self.splitters, self.shared, self.part = splitters, paths(splitters), None

    def nodes(self, part: int, word: str) -> tuple[int, list[int]]:
        """(the word's place in its part, numbers of the nodes of all that the word begins with)."""
        if part != self.part:
            self.part, self.last, self.stack, self.used, self.place = part, "", [0], part * SPAN + SPAN, -1
        known = common_prefix(self.last, word)
        sides = self.splitters[max(0, part - 1) : part + 1]
        on_path = max((common_prefix(s, word) for s in sides), default=0)
        del self.stack[known + 1 :]
        for d in range(known + 1, len(word) + 1):
            if d <= on_path:
                self.stack.append(self.shared[word[:d]])
            else:
                self.stack.append(self.used)
                self.used += 1
        self.last = word
        self.place += 1
        return self.place, self.stack


def splitters_of(words: DataFrame, key: str, count: int) -> list[str]:
    """Up to PARTS - 1 strings of up to SPLITTER characters that cut the words into even parts, from a
    sample of about SAMPLED words a part, chosen by hash. They say where a word goes, and nothing else."""
    parts = min(PARTS, -(-count // PART_WORDS))
    if parts < 2:
        return []
    sample = words.where(hash_fraction(F.col(key), 11) < min(1.0, parts * SAMPLED / count)).select(F.substring(key, 1, SPLITTER)).collect()
    ordered = sorted(r[0] for r in sample)
    return sorted({ordered[len(ordered) * i // parts] for i in range(1, parts)} - {""}) if ordered else []


def dealt(words: DataFrame, key: str, splitters: list[str]) -> DataFrame:
    """words with their part, each part in order in one task; a task may have several parts, one after the other."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([bisect_right(splitters, w) for w in b], dtype="int64")

    part = F.pandas_udf(run, "long", F.PandasUDFType.SCALAR_ITER)(F.col(key)) if splitters else F.lit(0).cast("long")
    return words.withColumn("part", part).repartition(len(splitters) + 1, "part").sortWithinPartitions("part", key)


def with_prefixes(words: DataFrame, splitters: list[str]) -> DataFrame:
    """(id, word, n, prefixes): ids follow the words' order by code point, prefixes are node numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(splitters)
        for b in batches:
            ids, prefixes = [], []
            for p, w in zip(b["part"].tolist(), b["word"], strict=True):
                place, nodes = trie.nodes(p, w)
                ids.append(p * SPAN + place)
                prefixes.append(np.array(nodes, np.int64))
            yield pd.DataFrame({"id": ids, "word": b["word"], "n": b["n"], "prefixes": prefixes})

    return dealt(words, "word", splitters).select("part", "word", "n").mapInPandas(run, "id long, word string, n long, prefixes array<long>")


def pairs(words: DataFrame, splitters: list[str]) -> DataFrame:
    """(before, after, kind, id, n): every word of (id, word, n, prefixes) whole at each cut and with
    each character left out, as pairs of nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, held, size = Trie(splitters), [], 0
        names = ("before", "after", "kind", "id", "n")
        out = lambda: pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held, strict=True)), strict=True)))
        for b in batches:
            for p, w, i, n, prefixes in zip(b["part"].tolist(), b["reversed"], b["id"].tolist(), b["n"].tolist(), b["prefixes"], strict=True):
                before = np.asarray(prefixes, np.int64)
                after = np.array(trie.nodes(p, w)[1][::-1], np.int64)  # after[j]: what begins at j
                letters = np.frombuffer(w[::-1].encode("utf-32-le"), np.uint32)
                kind = np.full(2 * len(w) + 1, WHOLE, np.int8)
                kind[len(w) + 1 :] = LATER
                kind[len(w) + 1 :][np.concatenate(([True], letters[1:] != letters[:-1]))] = FIRST
                held.append((np.concatenate((before, before[:-1])), np.concatenate((after, after[1:])), kind, np.full(len(kind), i), np.full(len(kind), n)))
                size += len(kind)
                if size >= PAIRS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    turned = words.withColumn("reversed", F.reverse("word"))
    given = dealt(turned.select("id", "n", "prefixes", "reversed"), "reversed", splitters).select("part", "reversed", "id", "n", "prefixes")
    return given.mapInPandas(run, "before long, after long, kind byte, id long, n long")


def rank(n: Column, word: Column) -> Column:
    """Larger for larger n, then for smaller words."""
    return F.struct(n.alias("n"), (-word).alias("minus"))


def neighbours(found: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words that have a near one; best is the rank of the most frequent of them."""
    groups = found.groupBy("before", "after").agg(F.collect_list(F.struct("kind", "id", "n")).alias("all")).where(F.size("all") > 1)
    ranks = lambda keep: F.sort_array(F.transform(F.filter("all", keep), lambda x: rank(x["n"], x["id"])), asc=False)
    groups = groups.select("all", ranks(lambda x: x["kind"] != WHOLE).alias("out"), ranks(lambda x: x["kind"] == FIRST).alias("first"), ranks(lambda x: x["kind"] == WHOLE).alias("whole"))
    nothing = F.lit(None).cast("struct<n: bigint, minus: bigint>")

    def of(x: Column) -> Column:
        longer = (x["kind"] == FIRST) & (F.size("whole") > 0)
        other = F.when(F.get("out", F.lit(0)) == rank(x["n"], x["id"]), F.get("out", F.lit(1))).otherwise(F.get("out", F.lit(0)))
        near = F.when(x["kind"] == WHOLE, F.size("first")).otherwise(F.size("out") - 1 + longer.cast("int"))
        best = F.when(x["kind"] == WHOLE, F.get("first", F.lit(0))).otherwise(F.greatest(other, F.when(longer, F.get("whole", F.lit(0))).otherwise(nothing)))
        return F.struct(x["id"].alias("id"), near.cast("bigint").alias("near"), best.alias("best"))

    return groups.select(F.inline(F.transform("all", of))).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def followed(links: DataFrame) -> DataFrame:
    """(id, root): where the links (id, form_id) of a forest lead to in the end, by doubling. A form is
    DOMINANCE times as frequent as its word, so chains are logarithmic in the counts, and rounds in that."""
    current = materialise(links.select("id", F.col("form_id").alias("root")))
    while True:
        following = current.select(F.col("id").alias("root"), F.col("root").alias("next"))
        current = materialise(current.select("id", "root").join(following, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not current.where("moved").limit(1).count():
            return current.select("id", "root")
        current = current.drop("moved")


def variants(counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of counts (word, n) that are long and frequent enough.

    Near words differ by one inserted, deleted or replaced code point; n_near counts them. The form is
    the most frequent near word, ties to the first by code point, where it is dominance times as
    frequent as the word or more, else null; the root is where forms lead to in the end, the word
    itself where it has none. Words must be distinct and not null; no words give no rows."""
    kept = materialise(counts.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)).select("word", "n"))
    count = kept.count()
    words = materialise(with_prefixes(kept, splitters_of(kept, "word", count)))
    turned = splitters_of(words.select(F.reverse("word").alias("reversed")), "reversed", count)
    near = neighbours(pairs(words, turned))
    form = (F.col("best.n") >= dominance * F.col("n"))
    found = materialise(
        words.select("id", "word", "n").join(near, "id", "left")
        .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, -F.col("best.minus")).alias("form_id"), F.when(form, F.col("best.n")).alias("form_n"))
    )
    roots = followed(found.where("form_id is not null"))
    named = lambda to, name: words.select(F.col("id").alias(to), F.col("word").alias(name))
    led = found.join(roots.withColumnRenamed("root", "root_id"), "id", "left").join(named("form_id", "form"), "form_id", "left").join(named("root_id", "_root"), "root_id", "left")
    return led.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
