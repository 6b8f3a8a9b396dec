"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint's 64 bits are four segments in a ring. When two fingerprints differ in at most three
bits, some segment starts a chain in which the differences of 1, 2, 3, 4 consecutive segments stay
within 3/4, 6/4, 9/4 and 3: none in the first, one in the first two, two in the first three. So two
fingerprints can only be linked if, for some segment, they are equal there and differ in one bit at
most in the next. That is an equality on 32 bits once single flips of the second segment are listed;
what the equality finds goes through the rest of the chain and then the whole Hamming distance.

Where very many fingerprints have the same 32 bits, the same holds once more for the other 32, as
four segments of 8 bits: such a bucket is split by an equality on 16 bits of them. What is left has
48 bits alike, so its size has a bound whatever the input's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.joins import join_counted
from .common import let, materialise, row_key

SEED = 42
SHINGLE = 3
SEGMENTS, BITS, WITHIN = 4, 16, 3
#: Shingles whose bits are added up at a time.
BLOCK = 1 << 16
#: Rows that a bucket should hold at most; larger ones are split.
PART = 4096
#: Buckets to split that are sent to all tasks; more are joined by shuffle.
LISTED = 100_000
#: Fingerprints that are compared with as many others at a time.
SQUARE = 1024


def fingerprint(text: str | None, hashed) -> int:
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    words = data.split()  # of bytes: the six ASCII spaces only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return hashed(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        k = min(n, i + BLOCK)
        spans = zip(starts[i:k].tolist(), ends[i + SHINGLE - 1 : k + SHINGLE - 1].tolist(), strict=True)
        h = np.fromiter((hashed(line[a:b], SEED) for a, b in spans), "<u8", k - i)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, fp) for every row: fp is the fingerprint as a signed bigint, 0 for a text without words."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, xxhash.xxh64_intdigest) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.struct("*").alias("doc"), F.pandas_udf(run, "long", F.PandasUDFType.SCALAR_ITER)(F.col(text)).alias("fp"))


def segment_of(value: Column, i: int, bits: int, segments: int = SEGMENTS) -> Column:
    return F.shiftrightunsigned(value, bits * (i % segments)).bitwiseAND(F.lit((1 << bits) - 1))


def flips(key: Column, bits: int) -> list[Column]:
    """The key with each zero among its last bits set, null for ones."""
    return [F.when(key.bitwiseAND(F.lit(1 << b)) == 0, key + F.lit(1 << b)) for b in range(bits)]


def ring_keys(value: Column, bits: int, flipped: bool = True) -> Column:
    """array<struct<key, flipped>>: for each segment its number, itself and the next segment, as the
    next one is and, where flipped is asked for, with each of its zero bits set. Of two values that differ
    in one bit of that segment, one has a zero there, so it is enough that zeros are set."""

    def keys(i: int) -> Column:
        key = F.lit(i << 2 * bits) + segment_of(value, i, bits) * F.lit(1 << bits) + segment_of(value, i + 1, bits)
        one = lambda k, f: F.when(k.isNotNull(), F.struct(k.alias("key"), F.lit(f).alias("flipped")))
        return F.array_compact(F.array(one(key, False), *([one(k, True) for k in flips(key, bits)] if flipped else [])))

    return F.concat(*[keys(i) for i in range(SEGMENTS)])


def other_half(fp: Column, key: Column) -> Column:
    """The 32 bits of a fingerprint that its ring key doesn't hold, as a number."""
    turn = lambda s: segment_of(fp, s + 2, BITS) + segment_of(fp, s + 3, BITS) * F.lit(1 << BITS)
    s = F.shiftrightunsigned(key, 2 * BITS)
    return F.when(s == 0, turn(0)).when(s == 1, turn(1)).when(s == 2, turn(2)).otherwise(turn(3))


def pairs_within(a: np.ndarray, b: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the pairs whose chain from segment holds and whose whole distance does."""
    x = a[:, None] ^ b[None, :]
    three = sum(1 << BITS * (i % SEGMENTS) for i in range(segment, segment + 3)) * ((1 << BITS) - 1)
    chain = np.bitwise_count(x & np.uint64(three)) <= 2
    return np.nonzero(chain & (np.bitwise_count(x) <= WITHIN))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels with the classes of a[i] and b[i] made one; a label is the smallest position of its class."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        la, lb = la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]


#: Kinds of rows that may meet in a cell: of bit 1 (flipped) and bit 2 (flipped in the other half), no two
#: rows share one, as two flipped rows need not meet.
MEET = [(k, m) for k in range(4) for m in range(k, 4) if k & m == 0]


def bucket_links(kinds: list[np.ndarray], first: bool, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold a cell's linked fingerprints together, one less than each class has.

    kinds has the fingerprints by kind. All pairs that may meet are compared, in blocks; a spanning
    forest is what leaves, so dense cells give no square of rows. Plain ones meet each other in the
    first part of a bucket only."""
    everything = np.unique(np.concatenate(kinds))
    labels = np.arange(len(everything))
    for k, m in MEET if first else MEET[1:]:
        left, right = kinds[k], kinds[m]
        for i in range(0, len(left), SQUARE):
            for j in range(i if k == m else 0, len(right), SQUARE):
                a, b = left[i : i + SQUARE], right[j : j + SQUARE]
                p, q = pairs_within(a, b, segment)
                if len(p):
                    labels = join_labels(labels, np.searchsorted(everything, a[p]), np.searchsorted(everything, b[q]))
    away = np.nonzero(labels != np.arange(len(labels)))[0]
    return everything[away], everything[labels[away]]


CELL = ["key", "deep", "part"]


def links_of_rows(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Links of all whole cells in rows, which are sorted by CELL."""
    key, deep, part = (rows[c].to_numpy() for c in CELL)
    fp, kind = rows["fp"].to_numpy().view(np.uint64), rows["kind"].to_numpy()
    cuts = np.nonzero((key[1:] != key[:-1]) | (deep[1:] != deep[:-1]) | (part[1:] != part[:-1]))[0] + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
    seen = [np.concatenate(([0], np.cumsum(kind == k))) for k in range(3)]
    has = [n[ends] > n[starts] for n in seen]
    worth = (ends - starts > 1) & (has[0] | has[1] & has[2])
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    starts, ends = starts[worth], ends[worth]
    two = ends - starts == 2  # most cells that hold more than one row hold two: those are done at once
    i = starts[two]
    if len(i):
        x, segment = fp[i] ^ fp[i + 1], (key[i] >> 2 * BITS).astype(np.int64)
        masks = np.array([sum(1 << BITS * (k % SEGMENTS) for k in range(s, s + 3)) * ((1 << BITS) - 1) for s in range(SEGMENTS)], np.uint64)
        meet = (kind[i] & kind[i + 1] == 0) & (x != 0) & ((part[i] == 0) | (kind[i] | kind[i + 1] != 0))
        fits = meet & (np.bitwise_count(x) <= WITHIN) & (np.bitwise_count(x & masks[segment]) <= 2)
        a.append(np.maximum(fp[i], fp[i + 1])[fits])
        b.append(np.minimum(fp[i], fp[i + 1])[fits])
    for s, e in zip(starts[~two].tolist(), ends[~two].tolist(), strict=True):
        x, y = bucket_links([fp[s:e][kind[s:e] == k] for k in range(4)], part[s] == 0, int(key[s] >> 2 * BITS))
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def crowded(unique: DataFrame) -> DataFrame:
    """(key, plain, all) of the buckets with more than PART rows or so that hold a plain one, plain 0 for
    those that hold none.

    A bucket's flipped rows are the plain rows of the 16 keys at most that lack one of its bits. If it
    has over PART rows in all, one of these 17 counts is over PART / 17, so only keys with so many
    plain rows are looked at, and only plain rows are counted."""
    plain = unique.select(F.explode(let(F.col("fp"), lambda fp: ring_keys(fp, BITS, flipped=False))).alias("k")).groupBy("k.key").agg(F.count(F.lit(1)).alias("n"))
    plain = materialise(plain.where(F.col("n") > 0))
    big = plain.where(F.col("n") > PART // 17)
    around = big.select("key", "n").unionByName(big.select(F.explode(F.array_compact(F.array(*flips(F.col("key"), BITS)))).alias("key"), "n"))
    around = around.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > PART)
    return materialise(around.join(plain, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("plain"), "all"))


def cells_of(unique: DataFrame) -> DataFrame:
    """(key, deep, part, kind, fp): every fingerprint in every cell where it may meet others.

    A bucket is one cell. A crowded one without plain rows is left out, for nothing there may meet. One
    with up to PART plain rows is dealt into parts: each flipped row goes to one, each plain row to all,
    which at most doubles its rows. One with more plain rows is split by ring keys of the other half of the
    bits, which multiplies its rows by 36 at most, however many they are."""
    rows = unique.select("fp", F.explode(let(F.col("fp"), lambda fp: ring_keys(fp, BITS))).alias("k")).select("fp", "k.key", F.col("k.flipped").cast("int").alias("kind"))
    hot = crowded(unique)
    n_hot = hot.count()
    none = F.lit(0).alias("deep"), F.lit(0).alias("part")
    if n_hot == 0:
        return rows.select("key", *none, "kind", "fp")
    marked = rows.join(F.broadcast(hot) if n_hot <= LISTED else hot, "key", "left")
    calm = marked.where(F.col("plain").isNull()).select("key", *none, "kind", "fp")
    parts = F.ceil(F.col("all") / PART).cast("int")
    to = F.when(F.col("kind") == 0, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), parts).cast("int")))
    dealt = marked.where((F.col("plain") > 0) & (F.col("plain") <= PART)).select("key", F.lit(0).alias("deep"), F.explode(to).alias("part"), "kind", "fp")
    inner = let(other_half(F.col("fp"), F.col("key")), lambda half: ring_keys(half, BITS // 2))
    split = marked.where(F.col("plain") > PART).select("key", F.explode(inner).alias("k"), "kind", "fp")
    split = split.select("key", (F.col("k.key") + 1).cast("int").alias("deep"), F.lit(0).alias("part"), (F.col("kind") + 2 * F.col("k.flipped").cast("int")).alias("kind"), "fp")
    return calm.unionByName(dealt).unionByName(split)


def links(unique: DataFrame) -> DataFrame:
    """(src, dst) with src > dst as unsigned numbers: links that join all fingerprints within reach.

    unique has one row for each fingerprint. No cell grows with the input: see cells_of()."""
    cells = cells_of(unique).repartition(*CELL).sortWithinPartitions(*CELL)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            same = (batch[CELL] == batch[CELL].iloc[-1]).all(axis=1).to_numpy()
            if same.all() and (not rest or (rest[0][CELL].iloc[-1] == batch[CELL].iloc[-1]).all()):  # a cell that goes on through the whole batch
                rest.append(batch)
                continue
            cut = int(np.argmax(same))
            whole = pd.concat([*rest, batch.iloc[:cut]]) if rest else batch.iloc[:cut]
            rest = [batch.iloc[cut:]]
            if len(whole):
                yield out(*links_of_rows(whole))
        if rest:
            yield out(*links_of_rows(pd.concat(rest)))

    def out(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return cells.mapInPandas(run, "src long, dst long")


#: A fingerprint or component with over one in so many rows is dealt over parts when it meets its rows again.
HOT_SHARE = 1000


def assigned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, fp, root, component_id) for every row; key tells rows of other id or text apart.

    Null ids and texts, repeated rows and empty tables as in near_duplicates()."""
    own = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    each = materialise(fingerprints(own).select("doc.doc_id", "doc.key", "fp"))
    unique = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(unique.select("fp")))
    named = unique.join(found, unique["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    smallest = materialise(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"), F.sum("n").alias("n")))
    rows, fps = smallest.agg(F.sum("n"), F.sum("fps")).first()
    table = join_counted(named, smallest.drop("n"), "root", "fps", F.col("fp"), max(1, (fps or 0) // HOT_SHARE))
    table = materialise(table.select("fp", "n", "root", "component_id"))
    return join_counted(each, table, "fp", "n", F.col("key"), max(1, (rows or 0) // HOT_SHARE)).select("doc_id", "key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id that links reach, itself included.

    Equal fingerprints, those of texts without words included, are one node and never pairs. A null
    doc_id takes part but is nobody's smallest; a component of null ids has a null component_id.
    Repeated rows each get a row; no rows give none; extra columns are not read."""
    return assigned(docs, doc_id, text).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of its smallest doc_id (a null id comes last; of rows
    that share the id, the one whose text has the smallest digest)."""
    one = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key")))
    stay = assigned(docs, doc_id, text).groupBy("root").agg(one["key"].alias("key")).select("key")
    kept = docs.select(row_key(doc_id, text).alias("key"), F.struct("*").alias("doc")).join(stay, "key", "left_semi")
    return kept.dropDuplicates(["key"]).select("doc.*")


def written(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
