"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_counted
from .common import STRETCH, let, materialise, row_key, running, running_offsets, upto

#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Other long runs that might be credentials; whether they are is left to who else has them.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
#: What a redacted secret leaves.
MASK = "<secret>"


def matches(text: Column, pattern: str, rank: int, keep: Callable[[Column], Column], value: Callable[[Column], Column] = lambda m: m) -> Column:
    """Leftmost non-overlapping matches that pass keep, as an array of (start, rank, end, value).

    Offsets are code points: the text between matches and the matches themselves, laid end to end."""

    def located(found: Column, between: Column) -> Column:
        steps = F.zip_with(found, F.slice(between, F.lit(2), F.size(found)), lambda m, b: F.length(m) + F.length(b))
        starts = F.transform(running_offsets(steps), lambda o: o + F.length(F.get(between, F.lit(0))))
        spans = F.zip_with(
            starts, found,
            lambda s, m: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("end"), value(m).alias("value"), keep(m).alias("ok")),
        )
        return F.transform(
            F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["value"].alias("value"))
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.exists(found, keep), let(F.split(text, pattern, -1), lambda between: located(found, between))).otherwise(F.array().cast(SPAN)),
    )


def base_spans(text: Column) -> Column:
    """Spans of the fixed kinds, one kind after the other; an empty text has none."""
    secret = lambda m: F.regexp_extract(m, ASSIGN, 2)
    long_hex = HEX.replace("+", "{24,}")  # a run is matched whole, so asking for its length first finds the same
    return F.concat(
        matches(text, ASSIGN, 0, lambda m: F.length(secret(m)) >= 6, secret),
        matches(text, ACCESS, 1, lambda m: F.length(m) >= 20),
        matches(text, long_hex, 2, lambda m: F.length(m) >= 24),
    )


def entropy(value: Column) -> Column:
    """Shannon entropy of a value's characters, in bits."""
    n = F.length(value).cast("double")
    part = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - part(c) * F.log2(part(c)))


def live_looking(value: Column, least_entropy: float) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (entropy(value) >= least_entropy)


def greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


def clear_of_base(spans: Column) -> Column:
    """Sorted spans without those of other kinds that overlap a base span.

    One does if a base span before it ends behind its start, or one after it starts before its end; both
    are running values over the base spans alone."""
    far = F.lit(2**62).cast("bigint")
    ends = lambda s: running(F.transform(s, lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(0)), F.lit(0).cast("bigint"), greater)
    starts = lambda s: F.reverse(running(F.transform(F.reverse(s), lambda x: F.when(x["rank"] < 3, x["start"]).otherwise(far)), far, lesser))

    def kept(s: Column) -> Column:
        marked = let(ends(s), lambda e: let(starts(s), lambda b: F.transform(s, lambda x, i: F.struct(x.alias("x"), F.get(e, i).alias("e"), F.get(b, i).alias("b")))))
        return F.transform(F.filter(marked, lambda m: (m["x"]["rank"] < 3) | (m["e"] <= m["x"]["start"]) & (m["b"] >= m["x"]["end"])), lambda m: m["x"])

    both = lambda s: F.exists(s, lambda x: x["rank"] < 3) & F.exists(s, lambda x: x["rank"] == 3)
    return let(spans, lambda s: F.when(both(s), kept(s)).otherwise(s))


def candidates(text: Column, least_entropy: float = 3.5) -> Column:
    """Base spans and other long runs that overlap none of them and look random, in the order of their
    starts. Work grows with the text and the number of spans, not with its square; an empty text has
    none, and equal matches at several places are spans of their own."""
    return clear_of_base(F.array_sort(F.concat(base_spans(text), matches(text, RUN, 3, lambda m: live_looking(m, least_entropy)))))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories, n) of every candidate over the whole corpus; n counts its spans.

    found has digest, owner, repository. A value that a third of all documents share is first
    reduced to one row for each owner and repository, in the map tasks."""
    each = found.groupBy("digest", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


#: A value is a widely copied example where it has more owners, and more repositories, than this share
#: of all that there are, or, where there are many, than the root of their number and than WIDE_MOST.
WIDE_SHARE, WIDE_MOST = 0.5, 10
#: A value with over one in so many spans is dealt over parts when it meets its counts.
HOT_SHARE = 1000


def widely(total: int, share: float, most: int | None = None) -> int:
    """How many of total may have a value that is no widely copied example. Without most it grows with the root of
    total: a key that leaked into 11 forks is no example among 100,000 owners, one that 317 have is."""
    return max(1, min(max(WIDE_MOST, math.isqrt(total)) if most is None else most, int(total * share)))


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: Sequence[str] = ("source",), repository: Sequence[str] = ("source", "lang"),
    wide_share: float = WIDE_SHARE, wide_most: int | None = None, least_entropy: float = 3.5, carry: Sequence[Column] = (),
) -> DataFrame:
    """One row for each row of docs: doc_id, spans array<struct<start, rank, end, owners, repositories,
    copied>> ordered by start then kind, and what carry names.

    Every candidate value is hashed, and the owners and repositories that have it are counted over all
    documents. It is copied, an example that went around, where more owners and more repositories have
    it than widely() allows of all that the corpus has; any other is taken for a credential of those
    that have it. Base spans always stay; a run that is no base span is added as kind `owned` unless
    it is copied.

    A null owner or repository is one of its own; a null text has no spans; repeated rows each get
    a row; an empty table gives none. Only named columns are read, so others cannot clash."""
    name = lambda cols: F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]))
    spans = F.transform(
        candidates(F.coalesce(F.col(text), F.lit("")), least_entropy),
        lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("digest")),
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), name(owner).alias("owner"), name(repository).alias("repository"), spans.alias("spans"),
        F.struct(F.lit(0).alias("_"), *carry).alias("carry"),
    )
    rows = materialise(rows)  # texts are read once; row ids are fixed from here on
    found = rows.select("row", "owner", "repository", F.explode("spans").alias("x")).select("row", "owner", "repository", "x.*")
    counts = materialise(ownership(found))
    every = rows.select("owner", "repository").distinct().agg(F.count_distinct("owner").alias("owners"), F.count(F.lit(1)).alias("repositories")).first()
    owners, repositories = (widely(n, wide_share, wide_most) for n in every)
    counts = counts.withColumn("copied", (F.col("owners") > owners) & (F.col("repositories") > repositories))
    limit = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    judged = join_counted(found, counts, "digest", "n", F.struct("row", "start", "rank"), limit)
    judged = judged.where((F.col("rank") < 3) | ~F.col("copied"))
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "owners", "repositories", "copied"))).alias("judged"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,owners:bigint,repositories:bigint,copied:boolean>>")
    return rows.join(by_row, "row", "left").select("doc_id", F.coalesce("judged", none).alias("spans"), "carry")


def written(spans: Column) -> Column:
    """kind:start:end for each span, comma-joined."""
    kind = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["rank"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with MASK in place of spans (sorted by start); spans that overlap are masked as one.

    What stands between two masks is cut out of a stretch of STRETCH masks and not of the whole text, so
    work grows with the text and not with its product with the number of spans."""
    cut = lambda whole, at, to: F.substring(whole, (at + 1).cast("int"), (to - at).cast("int"))

    def pieces(gaps: Column) -> Column:
        def block(b: Column) -> Column:
            def laid(some: Column) -> Column:
                start = F.get(some, F.lit(0))["from"]
                stretch = cut(text, start, F.get(some, F.size(some) - 1)["to"])
                return let(stretch, lambda s: F.array_join(F.transform(some, lambda g: F.concat(cut(s, g["from"] - start, g["to"] - start), F.lit(MASK))), ""))

            return let(F.slice(gaps, b * STRETCH + 1, F.lit(STRETCH)), laid)

        return F.array_join(F.transform(upto(F.ceil(F.size(gaps) / STRETCH).cast("int")), block), "")

    before = running(F.transform(spans, lambda x: x["end"]), F.lit(0).cast("bigint"), greater)
    gaps = let(before, lambda e: F.transform(spans, lambda x, i: F.struct(F.get(e, i).alias("from"), x["start"].alias("to"))))
    last = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x["end"]))
    return F.concat(let(F.filter(gaps, lambda g: g["to"] >= g["from"]), pieces), F.substr(text, (last + 1).cast("int")))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None, **options) -> DataFrame:
    """docs with every secret replaced by MASK; values that scan() finds widely copied stay. length names
    a column that holds the text's length, to be set anew where the text changes; options are scan()'s.

    Rows are matched by id and text, so repeated rows are all redacted, null ids too; a null text
    stays null; no rows give none. Only rows with a candidate are shuffled with their text."""
    key = row_key(doc_id, text)
    some = F.coalesce(F.col(text).rlike(f"{ASSIGN}|(?-i:{ACCESS}|{HEX.replace('+', '{24,}')}|{RUN})"), F.lit(False))
    cut = scan(docs, doc_id, text, carry=[key.alias("key"), some.alias("some")], **options).where("carry.some")
    cut = cut.select(F.col("carry.key").alias("key"), F.filter("spans", lambda x: ~x["copied"]).alias("cut"))
    cut = materialise(cut.groupBy("key").agg(F.first("cut").alias("cut"), F.count(F.lit(1)).alias("n")))
    packed = docs.select(F.struct("*").alias("doc"), some.alias("some"), key.alias("key"))
    clean = packed.where(~F.col("some")).select("doc")
    limit = max(1, (cut.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    joined = join_counted(packed.where("some").select("doc", "key", F.monotonically_increasing_id().alias("row")), cut, "key", "n", F.col("row"), limit)
    body = F.col(f"doc.`{text}`")
    redone = F.col("doc").withField(f"`{text}`", masked(body, F.col("cut")))
    joined = joined.select(F.when(F.size("cut") == 0, F.col("doc")).otherwise(redone).alias("doc"), F.size("cut").alias("n_cut"))
    if length:
        counted = F.col("doc").withField(f"`{length}`", F.length(body).cast(docs.schema[length].dataType))
        joined = joined.withColumn("doc", F.when(F.col("n_cut") == 0, F.col("doc")).otherwise(counted))
    return clean.select("doc.*").unionByName(joined.select("doc.*"))
